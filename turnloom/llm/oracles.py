"""SQL (DuckDB) for the queries that SQL can express on whole tables."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ALNUM_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINE_DEDUP = f"""
l as (select doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos,
        unnest(string_split(coalesce(text, ''), chr(10))) as line from {{docs}}),
k as (select *, {LOWER.format(f"trim(line, {SPACE})")} as key from l),
g as (select key, min(doc_id) as keeper from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.*, g.keeper is not null and k.doc_id <> g.keeper as gone from k left join g on k.key = g.key),
line_dedup as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
        coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '') as kept from m group by doc_id)"""

JACCARD = f"""
jw as (select doc_id, {SPACE_WORDS.format(LOWER.format("coalesce(text, '')"))} as w from {{docs}}),
s as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) as g from jw where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 80 * (x.n + y.n - o)),
both_ways as (select a, b from e union all select b, a from e),
reach(a, b) as (select a, b from both_ways union select r.a, x.b from reach r join both_ways x on r.b = x.a),
jaccard as (select d.doc_id, coalesce(any_value(n.n), 0) as n_shingles, least(d.doc_id, coalesce(min(reach.b), d.doc_id)) as component_id
        from {{docs}} d left join n on n.doc_id = d.doc_id left join reach on reach.a = d.doc_id group by d.doc_id)"""

CONTAMINATION = f"""
iw as (select item_id, {ALNUM_WORDS.format(LOWER.format("coalesce(text, '')"))} as w from benchmark),
win as (select distinct item_id, least(len(w), 13) as size, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + 12], ' '))) as g from iw where len(w) > 0),
dw as (select doc_id, {ALNUM_WORDS.format(LOWER.format("coalesce(text, '')"))} as w from {{docs}}),
sizes as (select distinct size from win),
dwin as (select doc_id, size, unnest(range(1, len(w) - size + 2)) as p0, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) as g
        from dw, sizes where len(w) >= size),
hit as (select doc_id, p0, win.size, item_id from dwin join win on win.g = dwin.g and win.size = dwin.size),
word_hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p0, p0 + size)) as p from hit) group by doc_id),
item_hit as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items from (select distinct doc_id, item_id::varchar as i from hit) group by doc_id),
contamination as (select dw.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
        coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
        from dw left join word_hit on word_hit.doc_id = dw.doc_id left join item_hit on item_hit.doc_id = dw.doc_id)"""

QUALITY = f"""
qw as (select doc_id, coalesce(source, chr(0)) as host, coalesce(text, '') as text, {SPACE_WORDS.format("coalesce(text, '')")} as w from documents),
ql as (select doc_id, host, text, pos, trim(line, {SPACE}) as stripped, line from
        (select doc_id, host, text, generate_subscripts(string_split(text, chr(10)), 1) as pos, unnest(string_split(text, chr(10))) as line from qw)),
line_stats as (select doc_id, sum(length(stripped)) as line_chars, count(*) filter (stripped <> '') - count(distinct line) filter (stripped <> '') as n_dup_lines from ql group by doc_id),
runs as (select doc_id, unnest(range(1, len(w) - 6)) as p0, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) as g from qw where len(w) >= 8),
again as (select doc_id, p0 from runs qualify count(*) over (partition by doc_id, g) > 1),
repeat_words as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(p0, p0 + 8)) as p from again) group by doc_id),
keyed as (select *, {LOWER.format("stripped")} as key from ql where length(stripped) >= 10),
hosts as (select host, count(distinct doc_id) as documents from qw group by host),
frequent as (select k.host, key from keyed k join hosts h on h.host = k.host group by k.host, key, h.documents having count(distinct doc_id) > 10 and count(distinct doc_id) > 0.01 * h.documents),
gone as (select doc_id, count(*) as n, sum(length(stripped)) as chars from keyed k join frequent f on f.host = k.host and f.key = k.key group by doc_id),
measures as (select q.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(text) - length(translate(text, '#*$%&|<>', '')))::bigint as n_symbols, s.n_dup_lines::bigint as n_dup_lines, coalesce(r.n, 0)::bigint as n_repeat_words,
        coalesce(g.n, 0)::bigint as n_removed_lines, (s.line_chars - coalesce(g.chars, 0))::bigint as kept_chars, s.line_chars
        from qw q join line_stats s on s.doc_id = q.doc_id left join repeat_words r on r.doc_id = q.doc_id left join gone g on g.doc_id = q.doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
    not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and kept_chars >= 0.3 * line_chars as kept, n_removed_lines, kept_chars from measures"""



def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::varchar))::varchar || ':' || {value}::varchar, '-')"


def _tree(name: str, levels: int) -> str:
    """CTEs {name}_0 … {name}_{levels} (tree, r, size, d) above {name}_0; a tree of one node stays as it is. {name}_root has each tree's root."""
    out = []
    for k in range(levels):
        out.append(
            f"{name}_{k + 1} as (select tree, r // 16 as r, (size + 15) // 16 as size, case when size = 1 then any_value(d) else sha256(string_agg(d, '' order by r)) end as d "
            f"from {name}_{k} group by tree, r // 16, size)"
        )
    return ",\n".join([*out, f"{name}_root as (select tree, d from {name}_{levels})"])


def _paths(name: str, levels: int) -> str:
    """CTE {name}_path (tree, r, step, l, g): the siblings left and right of each leaf's ancestor at each level."""
    steps = [
        f"select a.tree, a.r, {k} as step, coalesce(string_agg(b.d, '' order by b.r) filter (b.r < a.r // {16**k}), '') as l, coalesce(string_agg(b.d, '' order by b.r) filter (b.r > a.r // {16**k}), '') as g "
        f"from {name}_0 a join {name}_{k} b on b.tree = a.tree and b.r // 16 = a.r // {16 ** (k + 1)} where b.size > 1 group by a.tree, a.r"
        for k in range(levels)
    ]
    return f"{name}_path as ({' union all '.join(steps)})"


#: crc32 of a text, bit by bit.
CRC32 = (
    "xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::ubigint), lambda crc, b: "
    "list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, bit: xor(x >> 1, 3988292384::ubigint * (x & 1))), 4294967295::ubigint), 4294967295::ubigint)"
)
#: Levels that suffice for 16**8 rows of a source, and as many sources.
LEVELS = 8
_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE = f"""
md as (select *, coalesce('s' || source, '') as tree, sha256({_LEAF} || {_field("text")}) as d,
        sha256({_LEAF} || {_field(LOWER.format("text"))}) as lowered, {CRC32.format("doc_id::varchar")} % 5 = 0 as hit from documents),
m_leaf as (select *, row_number() over (partition by tree order by doc_id nulls first, d) - 1 as r, count(*) over (partition by tree) as size from md),
m_0 as (select tree, r, size, d from m_leaf),
{_tree("m", LEVELS)},
t_0 as (select '' as tree, row_number() over (order by encode(tree)) - 1 as r, count(*) over () as size, d, tree as of from m_root),
{_tree("t", LEVELS)},
{_paths("m", LEVELS)},
{_paths("t", LEVELS)},
m_way as (select l.tree, l.r, list({{'l': p.l, 'g': p.g}} order by p.step) filter (p.step is not null) as way from m_0 l left join m_path p on p.tree = l.tree and p.r = l.r group by l.tree, l.r),
t_way as (select t.of as tree, list({{'l': p.l, 'g': p.g}} order by p.step) filter (p.step is not null) as way from t_0 t left join t_path p on p.r = t.r group by t.of),
m_all as (select l.doc_id, l.d as leaf, s.d as subroot, t_root.d as root, list_concat(coalesce(m_way.way, []), coalesce(t_way.way, [])) as way,
        case when l.hit and l.text is not null then l.lowered else l.d end as own
        from m_leaf l join m_way on m_way.tree = l.tree and m_way.r = l.r join t_way on t_way.tree = l.tree join m_root s on s.tree = l.tree cross join t_root),
m_out as (select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda s: s.l || s.g), '')) as proof_sha256,
        list_reduce(way, lambda acc, s: sha256(s.l || acc || s.g), own) as folded_root from m_all)
select *, folded_root = root as verified from m_out"""

SQL = {
    "op4_quality_rules": f"with {QUALITY}",
    "op12_merkle_dataset_manifest": f"with {MERKLE}",
    "op2_ngram_jaccard_join": f"with recursive {JACCARD.format(docs='documents')} select * from jaccard",
    "op5_line_dedup": f"with {LINE_DEDUP.format(docs='documents')} select doc_id, n_lines, n_dropped, sha256(kept) as kept_sha256 from line_dedup",
    "op7_benchmark_decontamination": f"with {CONTAMINATION.format(docs='documents')} select * from contamination",
}
