"""SQL counterparts (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base32 of a SHA-1 in hexadecimal: digit i is bits 5i to 5i+4.
_BASE32 = """array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((((strpos('0123456789abcdef', substr(h, (5 * i) // 4 + 1, 1)) - 1) * 16
        + strpos('0123456789abcdef', substr(h, (5 * i) // 4 + 2, 1)) - 1) >> (3 - (5 * i) % 4)) & 31) + 1)::INT, 1)), '')"""


def _rendered(turns: str) -> str:
    text = "'<|im_start|>' || t.role || chr(10) || replace(t.text, '<|im_', '< |im_') || '<|im_end|>' || chr(10)"
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: {text}), 'string_agg', ''), '')"


def _mask(turns: str) -> str:
    runs = (
        "'-' || (13 + length(t.role)) || ' ' || CASE WHEN t.role = 'assistant' THEN '+' ELSE '-' END || "
        "(length(replace(t.text, '<|im_', '< |im_')) + 10) || ' -1'"
    )
    return f"coalesce(list_aggregate(list_transform({turns}, lambda t: {runs}), 'string_agg', ' '), '')"


def _digits(md5: str, first: int) -> str:
    return f"('0x' || substr({md5}, {first}, 8))::BIGINT"


def _crc32(text: str) -> str:
    """Unsigned crc32 of a text's bytes, bit by bit; ``text`` must be ASCII or given as a list of byte values."""
    bits = "list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, x))"
    return f"xor(list_reduce(list_prepend(4294967295, {text}), lambda acc, x: {bits}), 4294967295)"


def _merkle_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _merkle_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_merkle_field, ["doc_id", "source", "lang", n_chars, "text"])) + ")"


def _merkle_tree(name: str, nodes: str) -> str:
    """All nodes of the trees over ``nodes`` (tree, pos, node), level by level."""
    return f"""{name} AS (SELECT tree, 0 lv, pos, node, count(*) OVER (PARTITION BY tree) n FROM {nodes}
    UNION ALL SELECT tree, lv + 1, pos // 2, sha256(node || coalesce(behind, '')), (n + 1) // 2
    FROM (SELECT *, lead(node) OVER (PARTITION BY tree ORDER BY pos) behind FROM {name} WHERE n > 1) WHERE pos % 2 = 0)"""


def _merkle_fold(name: str, start: str, tree: str) -> str:
    """The nodes that each row of ``start`` (rid, tree, pos, node) folds to, level by level."""
    return f"""{name} AS (SELECT rid, tree, pos, 0 lv, node FROM {start}
    UNION ALL SELECT f.rid, f.tree, f.pos // 2, f.lv + 1, CASE WHEN s.node IS NULL THEN sha256(f.node)
        WHEN f.pos % 2 = 0 THEN sha256(f.node || s.node) ELSE sha256(s.node || f.node) END
    FROM {name} f JOIN {tree} o ON o.tree = f.tree AND o.lv = f.lv AND o.pos = f.pos AND o.n > 1
    LEFT JOIN {tree} s ON s.tree = f.tree AND s.lv = f.lv AND s.pos = xor(f.pos, 1::BIGINT))"""


ORACLES: dict[str, str] = {
    "op2_preference_format": f"""
WITH t AS (SELECT conv_id::BIGINT conv_id, md5(conv_id::BIGINT::VARCHAR) h,
        list({{'role': coalesce(role, 'user'), 'text': coalesce(text, '')}}
            ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) c
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1, 2),
p AS (SELECT *, list_filter(range(1, len(c) + 1), lambda k: c[k].role = 'assistant') a FROM t),
q AS (SELECT conv_id, h, c[: a[1 + {_digits('h', 9)} % len(a)] - 1] head, c[a[1 + {_digits('h', 17)} % len(a)] :] tail,
        {_digits('h', 1)} % (SELECT greatest(count(*) // 256, 1) FROM p WHERE len(a) > 0) circle
    FROM p WHERE len(a) > 0),
b AS (SELECT conv_id, count(*) OVER (PARTITION BY circle) n, list_concat(head, coalesce(
        lead(tail) OVER (PARTITION BY circle ORDER BY h, conv_id),
        first_value(tail) OVER (PARTITION BY circle ORDER BY h, conv_id))) r
    FROM q),
s AS (SELECT t.conv_id, c, CASE WHEN n > 1 THEN r ELSE c END r FROM t LEFT JOIN b ON b.conv_id = t.conv_id),
k AS (SELECT *, coalesce(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1),
        lambda k: c[k] IS NOT DISTINCT FROM r[k]), false) - 1, len(c)) k FROM s)
SELECT conv_id, k::INT prompt_turns, {_rendered('c[: k]')} prompt,
    {_rendered('c[k + 1 :]')} chosen, {_mask('c[k + 1 :]')} chosen_mask,
    {_rendered('r[k + 1 :]')} rejected, {_mask('r[k + 1 :]')} rejected_mask FROM k""",
    "op5_block_naming": f"""
WITH d AS (SELECT doc_id, {_LOWER} t FROM documents),
g AS (SELECT t, max(doc_id) keep_id, count(*) group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) text_sha256 FROM d JOIN g USING (t)""",
    "op6_zstd_warc": f"""
WITH d AS (SELECT page_id, coalesce(html, '') t FROM pages),
g AS (SELECT t, max(page_id) best FROM d GROUP BY t),
j AS (SELECT page_id, best, strlen(t) n, sha1(t) h FROM d JOIN g USING (t))
SELECT page_id, n payload_bytes, {_BASE32} payload_digest,
    CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END record_type,
    CASE WHEN page_id = best THEN NULL ELSE best END refers_to FROM j""",
    "op10_grouped_prefix_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ \\x09-\\x0D]+'), lambda x: x <> '') ws
    FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
        ELSE array_to_string(ws[i : i + 4], ' ') END g
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id x, b.doc_id y, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id x, doc_id z FROM documents UNION SELECT b.y, r.z FROM r JOIN b ON b.x = r.x WHERE r.z < b.y)
SELECT d.doc_id, coalesce(n.n, 0) n_shingles, min(z) component_id
FROM documents d JOIN r ON r.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 pos,
        row_number() OVER () rid
    FROM (SELECT doc_id, coalesce('s' || lang, 'n') tree, {_merkle_leaf("n_chars")} leaf,
            CASE WHEN {_crc32("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)")} % 7 = 0
                THEN {_merkle_leaf("(n_chars + 1)")} END tampered FROM documents)),
b AS (SELECT tree, pos, leaf AS node FROM l),
{_merkle_tree("u", "b")},
r AS (SELECT tree, node FROM u WHERE n = 1),
t AS (SELECT '' tree, tree AS lang, row_number() OVER (ORDER BY tree) - 1 pos, node FROM r),
{_merkle_tree("v", "t")},
g AS (SELECT node FROM v WHERE n = 1),
i AS (SELECT rid, u.lv, u.node FROM l JOIN u ON u.tree = l.tree AND u.pos = xor(l.pos >> u.lv, 1::BIGINT)
    UNION ALL SELECT rid, 1000 + v.lv, v.node FROM l JOIN t ON t.lang = l.tree JOIN v ON v.pos = xor(t.pos >> v.lv, 1::BIGINT)),
p AS (SELECT rid, sha256(string_agg(node, '' ORDER BY lv)) proof FROM i GROUP BY rid),
c AS (SELECT rid, tree, pos, coalesce(tampered, leaf) node FROM l),
{_merkle_fold("f", "c", "u")},
d AS (SELECT rid, node FROM f QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lv DESC) = 1),
e AS (SELECT d.rid, '' tree, t.pos, d.node FROM d JOIN l USING (rid) JOIN t ON t.lang = l.tree),
{_merkle_fold("h", "e", "v")},
k AS (SELECT rid, node FROM h QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lv DESC) = 1)
SELECT doc_id, leaf, r.node subroot, g.node root, coalesce(proof, sha256('')) proof_sha256, k.node folded_root,
    k.node = g.node verified
FROM l JOIN r USING (tree) JOIN g ON true JOIN k USING (rid) LEFT JOIN p USING (rid)""",
    "op11_spelling_variants": f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') w
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) w FROM documents)),
c AS (SELECT doc_id, w, count(*) n FROM r GROUP BY ALL),
h AS (SELECT w, n, {_crc32("list_transform(range(1, strlen(k) + 1), lambda i: ('0x' || hex(k)[2 * i - 1 : 2 * i])::BIGINT)")} h
    FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w k FROM c)),
t AS (SELECT CASE WHEN h % 199 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END word, n FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT n FROM t WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS MATERIALIZED (SELECT word, i, word[: i - 1] || word[i + 1 :] cut FROM v, unnest(range(1, length(word) + 1)) u(i)),
e AS (SELECT a.word x, b.word y FROM d a JOIN d b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
    UNION SELECT d.word, v.word FROM d JOIN v ON v.word = d.cut
    UNION SELECT v.word, d.word FROM d JOIN v ON v.word = d.cut),
m AS (SELECT x, y, v.n, count(*) OVER (PARTITION BY x) n_near FROM e JOIN v ON v.word = y
    QUALIFY row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) = 1),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT n_near, CASE WHEN m.n >= 5 * v.n THEN y END form,
    CASE WHEN m.n >= 5 * v.n THEN m.n END form_n FROM v LEFT JOIN m ON m.x = v.word),
s AS (SELECT word, word AS top, 0 k FROM f UNION ALL SELECT s.word, f.form, k + 1 FROM s JOIN f ON f.word = s.top WHERE f.form IS NOT NULL),
z AS (SELECT word, top AS root FROM s QUALIFY row_number() OVER (PARTITION BY word ORDER BY k DESC) = 1)
SELECT word, n, n_near, form, form_n, root FROM f JOIN z USING (word)""",
}
