"""SQL of those operators that SQL can express, for engines with lambdas and recursion over tables."""

#: White space of a message.
BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def crc32_sql(text: str) -> str:
    """The unsigned crc32 of an ASCII text: every byte and seven zeros are taken in, one bit shifted out at a time."""
    taken = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384::bigint) ELSE xor(c, b) >> 1 END"
    return f"xor(list_reduce({taken}, lambda c, b: {step}, 4294967295::bigint), 4294967295::bigint)"


def least(*items: str) -> str:
    """The least of items {cost, audit, text, whether it has a line}; null ones don't count."""
    return f"list_min([{', '.join(items)}])"


def edited(item: str, cost: str | int, edit: str, line: str | None) -> str:
    """An item after an edit that adds a line to its text, or none; no item stays none."""
    text = f"{item}.t" if line is None else f"concat({item}.t, CASE WHEN {item}.n THEN chr(10) ELSE '' END, {line})"
    return f"CASE WHEN {item} IS NOT NULL THEN {{'c': {item}.c + {cost}, 'a': {item}.a || '{edit}', 't': {text}, 'n': {f'{item}.n' if line is None else 'true'}}} END"


def kept(item: str, initial: str) -> str:
    return f"CASE WHEN NOT m.gone AND left(m.role, 1) = '{initial}' THEN {edited(item, 'm.cut::int', 'K', KEPT_LINE)} END"


def rerolled(item: str, role: str) -> str:
    return f"CASE WHEN NOT m.gone THEN {edited(item, '2 + m.cut::int', 'R', f"'{role}:' || m.text")} END"


KEPT_LINE = "m.role || ':' || m.text"
#: The least item of nothing (o), system (s), an open question (u) and pairs (p) after message m, from those of w before it.
SCANNED = {
    "o": edited("w.o", 3, "D", None),
    "s": least(edited("w.s", 3, "D", None), kept("w.o", "s")),
    "u": least(edited("w.u", 3, "D", None), *(kept(f"w.{x}", "u") for x in "osp"), *(rerolled(f"w.{x}", "user") for x in "osp")),
    "p": least(edited("w.p", 3, "D", None), kept("w.u", "a"), rerolled("w.u", "assistant")),
}

#: Over the whole table: one column of items after another, an insertion of a question, an answer, a question after each message.
OP11_SQL = f"""
WITH RECURSIVE damaged AS (
    SELECT conv_id, turn, unnest(range(CASE WHEN lot = 3 THEN 2 ELSE 1 END)) AS copy,
           CASE WHEN lot = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
           CASE lot WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text
    FROM (SELECT *, {crc32_sql("concat(coalesce(conv_id::varchar, ' '), ':', coalesce(turn::varchar, ' '))")} % 20 AS lot FROM conversations)
    WHERE lot <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), encode(text), copy) AS i FROM damaged
), shown AS (
    SELECT *, rtrim(text, {BLANKS}) AS seen, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
           left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair
    FROM placed
), message AS MATERIALIZED (
    SELECT *, seen = '' AS blank, seen <> '' AND again AS duplicate, seen <> '' AND NOT again AND right(seen, 1) NOT IN ('.', '!', '?') AS cut, seen = '' OR again AS gone
    FROM shown
), ids AS (
    SELECT DISTINCT conv_id FROM conversations
), walk(conv_id, i, o, s, u, p) AS (
    SELECT conv_id, 0, {{'c': 0, 'a': '', 't': '', 'n': false}}, NULL::STRUCT(c INTEGER, a VARCHAR, t VARCHAR, n BOOLEAN),
           {{'c': 2, 'a': 'I', 't': 'user:', 'n': true}}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:', 'n': true}}
    FROM ids
    UNION ALL
    SELECT conv_id, i, o, s, {least("u", *(edited(x, 2, "I", "'user:'") for x in ("o", "s", "p1")))}, p1
    FROM (
        SELECT *, {least("p", edited("u1", 2, "I", "'assistant:'"))} AS p1
        FROM (
            SELECT *, {least("u", *(edited(x, 2, "I", "'user:'") for x in ("o", "s", "p")))} AS u1
            FROM (
                SELECT w.conv_id, m.i, {SCANNED['o']} AS o, {SCANNED['s']} AS s, {SCANNED['u']} AS u, {SCANNED['p']} AS p
                FROM walk w JOIN message m ON w.conv_id IS NOT DISTINCT FROM m.conv_id AND m.i = w.i + 1
            )
        )
    )
), repaired AS (
    SELECT conv_id, {least("o", "p")} AS item FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
           count_if(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM message GROUP BY conv_id
)
SELECT r.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate,
       coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, item.c::bigint AS cost, item.a AS audit, sha256(item.t) AS repaired_sha256
FROM repaired r LEFT JOIN counted c ON r.conv_id IS NOT DISTINCT FROM c.conv_id
"""

#: Over the whole table: all scores of all queries.
OP12_SQL = """
WITH usable AS (
    SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor(64 * x::double)) AS vec FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
), scored AS (
    SELECT q.vec_id AS query_id, q.n AS query, c.vec_id, c.n, list_inner_product(q.vec, c.vec)::bigint AS score
    FROM usable q JOIN usable c ON q.n <> c.n AND len(q.vec) = len(c.vec) WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id NULLS LAST, n))::int AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""

#: Over the whole table: lists of digests level by level, and a walk from every leaf to the root.
OP13_SQL = f"""
WITH RECURSIVE rows_ AS (
    SELECT doc_id, source, text,
           CASE WHEN {crc32_sql('doc_id::varchar')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claimed,
           concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                  coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) AS head
    FROM documents
), hashed AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(claimed) || ':' || claimed, '-')) AS claimed
    FROM rows_
), leaves AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), tree(source, level, nodes) AS (
    SELECT source, 0, list(leaf ORDER BY i) FROM leaves GROUP BY source
    UNION ALL
    SELECT source, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1:3 * j + 3], '')))
    FROM tree WHERE len(nodes) > 1
), subroots AS (
    SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i FROM tree WHERE len(nodes) = 1
), upper_(level, nodes) AS (
    SELECT 0, list(subroot ORDER BY i) FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range((len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1:3 * j + 3], '')))
    FROM upper_ WHERE len(nodes) > 1
), height AS (
    SELECT source, max(level) AS levels FROM tree GROUP BY source
), node AS MATERIALIZED (
    SELECT source, level, unnest(nodes) AS digest, unnest(range(len(nodes))) AS j, len(nodes) AS n FROM tree
    UNION ALL
    SELECT h.source, u.level + h.levels, unnest(u.nodes), unnest(range(len(u.nodes))), len(u.nodes) FROM upper_ u, height h
), run AS MATERIALIZED (
    SELECT source, level, j // 3 AS parent, list(digest ORDER BY j) AS digests, min(j) AS first FROM node WHERE n > 1 GROUP BY source, level, j // 3
), path AS MATERIALIZED (
    SELECT l.source, l.i, s.i AS top, h.levels, l.leaf, l.claimed, l.doc_id, s.subroot
    FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN height h ON l.source IS NOT DISTINCT FROM h.source
), walk AS (
    SELECT source, i, top, levels, leaf, doc_id, subroot, 0 AS level, CASE WHEN levels = 0 THEN top ELSE i END AS j, claimed AS node, '' AS siblings FROM path
    UNION ALL
    SELECT w.source, w.i, w.top, w.levels, w.leaf, w.doc_id, w.subroot, w.level + 1,
           CASE WHEN w.level + 1 = w.levels THEN w.top ELSE w.j // 3 END,
           sha256(array_to_string(list_transform(range(len(r.digests)), lambda k: CASE WHEN k = w.j - r.first THEN w.node ELSE r.digests[k + 1] END), '')),
           w.siblings || array_to_string(list_transform(list_filter(range(len(r.digests)), lambda k: k <> w.j - r.first), lambda k: r.digests[k + 1]), '')
    FROM walk w JOIN run r ON w.source IS NOT DISTINCT FROM r.source AND w.level = r.level AND w.j // 3 = r.parent
)
SELECT doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, node AS folded_root, node = root AS verified
FROM (SELECT *, (SELECT nodes[1] FROM upper_ WHERE len(nodes) = 1) AS root, row_number() OVER (PARTITION BY source, i ORDER BY level DESC) AS last FROM walk) WHERE last = 1
"""
