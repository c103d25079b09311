"""Both log formats in plain Python: random files, and the turns that the rules give for them, line by line."""

import json

TOWNS = "Bergen Cadiz Derry Ghent Jena Lille Malmö Nantes Oulu Parma Riga Siena Turku Utrecht Vigo Zadar".split()
MARKED = ["route <command-args>{}</command-args>", "{} <system-reminder> keep right", "Caveat: The messages below were about {}"]
LED = [" \n## Context Usage of {}", "Base directory for this skill: /maps/{}", "[Request interrupted by user near {}]"]
INSIDE = ["what does 'Base directory for this skill:' say on {}?", "{} has ## Context Usage in it"]
TERMINAL = ("end_turn", "stop_sequence")


def _line(record):
    return json.dumps(record, ensure_ascii=False)


def block_file(rng, size):
    """Lines of a block log, each with what a reader should make of it: (line, kind, facts)."""
    out, entry = [], rng.choice([None, "cli", "sdk-cli", "vscode"])
    for k in range(size):
        town, ts = rng.choice(TOWNS), f"2026-05-{1 + k % 28:02d}T08:{k % 60:02d}:00Z"
        head = {"timestamp": ts, "sessionId": f"trip-{k % 3}", "cwd": f"/maps/{town}", "gitBranch": rng.choice(["", "north", None])}
        if entry and rng.random() < 0.5:
            head["entrypoint"] = entry
        facts = {"ts": ts, **head}
        roll = rng.random()
        if roll < 0.35:
            text = rng.choice(["way to {}", "{}, please", *INSIDE]).format(town)
            content, said = text, text
            if rng.random() < 0.4:
                content = [{"type": "text", "text": text}, {"type": "image", "source": {}}, None, {"type": "text", "text": "?"}]
                said = text + "?"
            elif rng.random() < 0.1:
                content, said = None, ""
            out.append((_line({"type": "user", **head, "message": {"role": "user", "content": content}}), "prompt", {**facts, "text": said}))
        elif roll < 0.5:
            content = rng.choice([*MARKED, *LED]).format(town)
            if rng.random() < 0.3:
                content = rng.choice([[{"type": "tool_result", "content": town}, {"type": "text", "text": town}], [{"type": "image"}], [{"type": "text", "text": town}, 7]])
            out.append((_line({"type": "user", **head, "message": {"role": "user", "content": content}}), "other", facts))
        elif roll < 0.9:
            message = {"id": rng.choice([f"a{k % 4}", f"a{k % 4}", "", None]), "stop_reason": rng.choice(["end_turn", "stop_sequence", "max_tokens", None])}
            pieces = [rng.choice([town, "north", ""]) for _ in range(rng.randrange(3))]
            message["content"] = [{"type": "thinking", "thinking": "hm"}, *({"type": "text", "text": p} for p in pieces)]
            if rng.random() < 0.6:
                message["usage"] = {"output_tokens": rng.randrange(90)} if rng.random() < 0.9 else {}
            if rng.random() < 0.5:
                message["model"] = rng.choice(["compass", "sextant", "<synthetic>", ""])
            side = rng.random() < 0.1
            out.append((_line({"type": "assistant", **head, "isSidechain": side, "message": message}), "other" if side else "answer", {**facts, **message, "pieces": pieces}))
        else:
            broken = rng.choice(["{" + town, _line({"type": "user", "message": {"content": town}}) + "}", _line({"type": "user", **head, "sessionId": 3, "message": {"content": town}})])
            out.append((broken, "broken", {}))
    return out


def block_turns(lines, idle):
    """(turns, offset of the held prompt or None) of one file."""
    offset, turns = 0, []
    entry = next((f["entrypoint"] for _, _, f in lines if f.get("entrypoint")), None)
    for line, kind, f in lines:
        if kind == "prompt":
            turns.append({"at": offset, "facts": f, "pieces": [], "tokens": {}, "model": None, "stop": None})
        elif kind == "answer" and turns:
            turn, who = turns[-1], f["id"] or "line:" + f["ts"]
            turn["pieces"] = list(dict.fromkeys([*turn["pieces"], *((who, p) for p in f["pieces"] if p)]))
            if "usage" in f:
                turn["tokens"].setdefault(who, f["usage"].get("output_tokens", 0))
            if not turn["model"] and f.get("model") not in (None, "", "<synthetic>"):
                turn["model"] = f["model"]
            turn["stop"] = f["stop_reason"]
        offset += len(line.encode()) + 1
    held = turns.pop()["at"] if turns and not (idle and turns[-1]["stop"] in TERMINAL) else None
    out = []
    for t in turns:
        branch = t["facts"]["gitBranch"]
        out.append(
            (
                t["at"], t["facts"]["text"], "".join(p for _, p in t["pieces"]) or None, sum(t["tokens"].values()) if t["tokens"] else None, t["model"],
                t["facts"]["sessionId"], t["facts"]["cwd"] + (f" @{branch}" if branch else ""), entry if entry in ("cli", "sdk-cli") else "unknown",
            )
        )
    return out, held


def rollout_file(rng, size):
    origin, source = rng.choice([("codex-tui", "cli"), ("codex-tui", "vscode"), ("codex_exec", "cli"), ("codex-tui", "exec"), (None, {"x": 1})])
    at = lambda k: f"2026-06-{1 + k % 28:02d}T09:00:{k % 60:02d}.5Z"
    record = lambda k, kind, payload: _line({"timestamp": at(k), "type": kind, "payload": payload})
    header = {"id": "walk", "cwd": "/coast", "originator": origin, "source": source}
    out = [(record(0, "session_meta", header), "header", {"silent": origin == "codex_exec" or source == "exec"})]
    if rng.random() < 0.3:  # a resumed session repeats its header
        out.append((record(0, "session_meta", {**header, "id": "later"}), "other", {}))
    for k in range(1, size):
        town, roll = rng.choice(TOWNS), rng.random()
        message = lambda role, parts: record(k, "response_item", {"type": "message", "role": role, "content": parts})
        if roll < 0.3:
            parts = [{"type": "input_text", "text": town}, *rng.choice([[], [None, {"type": "input_image"}, {"type": "input_text", "text": "!"}]])]
            out.append((message("user", parts), "prompt", {"text": town + "!" * (len(parts) > 1)}))
        elif roll < 0.6:
            parts = [{"type": "output_text", "text": f"to {town}"}, *rng.choice([[], [{"type": "output_text", "text": " and back"}]])]
            out.append((message("assistant", parts), "answer", {"text": "".join(p["text"] for p in parts)}))
        elif roll < 0.7:
            out.append((record(k, "turn_context", {"model": f"boots-{k % 3}", "cwd": "/coast"}), "model", {"model": f"boots-{k % 3}"}))
        elif roll < 0.8:
            text = rng.choice(["<user_shell_command>\nls {}", "  <environment_context>{}", "# AGENTS.md instructions for {}", "<turn_aborted> in {}"]).format(town)
            out.append((message("user", [{"type": "input_text", "text": text}]), "other", {}))
        else:
            other = [
                message("developer", [{"type": "input_text", "text": town}]), record(k, "compacted", {"replacement_history": [{"role": "user", "content": town}]}),
                record(k, "event_msg", {"type": "note"}), record(k, "response_item", {"type": "reasoning", "role": "user", "content": []}),
                message("user", []), message("user", town), message("assistant", [{"type": "output_text", "text": 1}]), record(k, "turn_context", {"model": ""}), "{" + town,
            ]
            out.append((rng.choice(other), "other", {}))
    return out


def rollout_turns(lines, idle):
    """(turns, offset of the held prompt or None, offsets of lost prompts) of one file."""
    offset, model, waiting, turns, lost = 0, None, None, [], []
    for line, kind, f in lines:
        if kind == "model":
            model = f["model"]
        elif kind == "prompt":
            lost += [waiting[0]] if waiting else []
            waiting = (offset, f["text"], model)
        elif kind == "answer" and waiting:
            turns.append((waiting[0], waiting[1], f["text"], waiting[2]))
            waiting = None
        offset += len(line.encode()) + 1
    if lines[0][2]["silent"]:
        return [], None, []
    if waiting and idle:
        turns.append((waiting[0], waiting[1], None, waiting[2]))
    return turns, waiting[0] if waiting and not idle else None, lost
