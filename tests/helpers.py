"""Short builders for log lines."""

import json


def user(content, ts="2026-03-01T10:00:00Z", **more):
    return json.dumps(
        {"type": "user", "isSidechain": False, "sessionId": "a1", "cwd": "/src", "timestamp": ts, **more, "message": {"role": "user", "content": content}},
        ensure_ascii=False,
    )


def reply(mid, *texts, tokens=None, model=None, stop="end_turn", ts="2026-03-01T10:00:05Z", **more):
    message = {"id": mid, "content": [{"type": "text", "text": t} for t in texts], "stop_reason": stop}
    if tokens is not None:
        message["usage"] = {"output_tokens": tokens}
    if model is not None:
        message["model"] = model
    return json.dumps({"type": "assistant", "timestamp": ts, **more, "message": message}, ensure_ascii=False)


def record(kind, payload, ts="2026-03-01T10:00:00.123Z"):
    return json.dumps({"timestamp": ts, "type": kind, "payload": payload}, ensure_ascii=False)


def header(source="cli", originator="codex-tui", sid="sess-1"):
    return record("session_meta", {"id": sid, "cwd": "/src/x", "originator": originator, "source": source})


def context(model):
    return record("turn_context", {"model": model, "cwd": "/src/x"})


def said(role, text, ts="2026-03-01T10:00:00.123Z"):
    kind = "output_text" if role == "assistant" else "input_text"
    return record("response_item", {"type": "message", "role": role, "content": [{"type": kind, "text": text}]}, ts)
