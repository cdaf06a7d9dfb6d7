"""SQL for the queries of this subpackage that SQL can express over whole tables."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
SAID = "<|im_end|><|im_start|>assistant ok"

#: The words of every document, the windows of every item, and where they meet.
DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, i.i, i.i + least(13, len(w)) - 1), ' ') AS win
       FROM b, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) i(i) WHERE len(w) > 0),
dw AS (SELECT r, i.i AS s, n.n, array_to_string(list_slice(w, i.i, i.i + n.n - 1), ' ') AS win
       FROM d, (SELECT DISTINCT n FROM bw) n(n), unnest(generate_series(1, len(w) - n.n + 1)) i(i) WHERE len(w) >= n.n),
hit AS (SELECT r, s, dw.n, item FROM dw JOIN bw ON bw.win = dw.win AND bw.n = dw.n),
words AS (SELECT r, count(DISTINCT j.j) AS n_hit FROM hit, unnest(generate_series(s, s + n - 1)) j(j) GROUP BY 1),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hit) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\\\1|', 'g')"
_ROLE = _ESCAPED.format(r"replace(replace(role, '\', '\\'), chr(10), '\n')")

#: Lengths and digests of every conversation; a turn adds two control strings and two newlines.
CHAT = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'),
e AS (SELECT *, length({_ROLE}) + length({_ESCAPED.format("text")}) + {len("<|im_start|>") + len("<|im_end|>") + 2} AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


#: CRC-32 of a number's decimal digits, bit by bit.
_CRC = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""

#: Every prefix of every rebuilt conversation as a list; nodes are its distinct values.
TRIE = f"""
WITH own AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p
  FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, {_CRC} % 4 AS h FROM (SELECT DISTINCT c FROM own)),
path AS (SELECT h.c, 0 AS src, p, r, x FROM h JOIN own ON own.c = h.c - h.c % 20 AND p < h
  UNION ALL SELECT own.c, 1, p, r, x FROM own JOIN h ON h.c = own.c AND p >= h),
steps AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY src, p) AS d, struct_pack(r := r, x := x) AS turn,
    len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')) AS w FROM path),
pre AS (SELECT c, d, w, list(turn) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS way FROM steps
  UNION ALL SELECT c, 0, 0, NULL FROM h),
nodes AS (SELECT way, d, min(c) AS conv_id, count(*) AS n, any_value(w) AS w FROM pre GROUP BY way, d),
up AS (SELECT *, CASE WHEN d > 1 THEN way[1:d - 1] END AS pre FROM nodes),
kids AS (SELECT pre, count(*) AS k FROM up WHERE d > 0 GROUP BY pre),
full_ AS (SELECT up.*, coalesce(k, 0) AS k FROM up LEFT JOIN kids ON up.way IS NOT DISTINCT FROM kids.pre),
below AS (SELECT CASE WHEN e.e > 0 THEN way[1:e.e] END AS top, sum((n - 1) * w) AS saved, count(*) FILTER (k = 0) AS leaves
  FROM full_, unnest(range(0, d + 1)) e(e) GROUP BY 1),
ends AS (SELECT way, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY c) AS last FROM pre) WHERE d = last GROUP BY way)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, CAST(b.leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_ f JOIN below b ON f.way IS NOT DISTINCT FROM b.top LEFT JOIN ends e ON f.way IS NOT DISTINCT FROM e.way
LEFT JOIN full_ p ON f.d > 0 AND p.d = f.d - 1 AND p.way IS NOT DISTINCT FROM f.pre"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": CHAT, "op6_benchmark_decontamination": DECONTAMINATION, "op11_prefix_trie": TRIE}
