"""SQL of the operators whose rules are folds: conversation repair, shuffled shards, fill-in-middle."""

from __future__ import annotations

#: One step of CRC-32 for a byte ``b`` that is already mixed into ``c``.
_EIGHT = "list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST({} AS BIGINT))"


def _remainder(half: int) -> int:
    """CRC-32 of four bits."""
    for _ in range(4):
        half = half >> 1 ^ (3988292384 if half & 1 else 0)
    return half


def _drawn(*key: str) -> str:
    joined = " || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)
    return f"CAST('0x' || substr(sha256({joined}), 1, 8) AS BIGINT)"


def fill_in_middle() -> str:
    h = [f"CAST('0x' || substr(h, {8 * k + 1}, 8) AS BIGINT)" for k in range(4)]
    return f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
            FROM documents
        ), c AS (
            SELECT doc_id, t, n, least({h[0]} % (n + 1), {h[1]} % (n + 1)) AS a, greatest({h[0]} % (n + 1), {h[1]} % (n + 1)) AS b,
                   CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {h[2]} % 100 >= 90 THEN 'plain'
                        WHEN {h[3]} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), o AS (
            SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s,
                   CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
            FROM c
        ), k AS (SELECT *, instr(o, '<P>') AS kp, instr(o, '<S>') AS ks, instr(o, '<M>') AS km FROM o)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(o) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN o
                   WHEN 'psm' THEN substr(o, kp + 3, ks - kp - 3) || substr(o, km + 3) || substr(o, ks + 3, km - ks - 3)
                   ELSE substr(o, kp + 3, km - kp - 3) || substr(o, km + 3) || substr(o, ks + 3, kp - ks - 3) END) AS restored_sha256
        FROM k"""


def shuffled_shards(shards: int, bucket_rows: int, bucket_bytes: int, seed: int = 1) -> str:
    # Half a byte at a time, low half first, by the 16 remainders.
    table = [_remainder(k) for k in range(16)]
    half = "instr('0123456789ABCDEF', substr(y, 2 * (i // 2) + 2 - i % 2, 1)) - 1"
    step = f"xor(crc >> 4, {table}[xor(crc & 15, {half}) + 1])"
    return f"""
        WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
        c AS (
            SELECT k, CAST(0 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS crc FROM d
            UNION ALL
            SELECT k, pos + 512, list_reduce(range(length(y)), lambda crc, i: {step}, crc)
            FROM (SELECT c.k, pos, crc, substr(x, 2 * pos + 1, 1024) AS y FROM c JOIN d USING (k) WHERE pos < length(x) // 2)
        ), s AS (
            SELECT doc_id, CAST(length(x) // 2 + 8 AS BIGINT) AS size, xor(crc, 4294967295) AS crc
            FROM c JOIN d USING (k) WHERE pos >= length(x) // 2
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, size, crc) - 1 AS nr, count(*) OVER () AS total,
                   greatest(1, CAST(ceil(count(*) OVER () / {bucket_rows}) AS BIGINT), CAST(ceil(sum(size) OVER () / {bucket_bytes}) AS BIGINT)) AS buckets
            FROM s
        ), b AS (SELECT *, {_drawn(str(seed), "coalesce(CAST(doc_id AS VARCHAR), '')", "size", "crc", "nr")} % buckets AS bucket FROM n),
        l AS (
            SELECT bucket, any_value(total) AS total, list(struct_pack(doc_id, size, crc) ORDER BY doc_id NULLS FIRST, size, crc, nr) AS g
            FROM b GROUP BY bucket
        ), f AS (
            SELECT bucket, total, g, sum(len(g)) OVER (ORDER BY bucket) - len(g) AS start,
                   list_reduce(list_transform(range(len(g)), lambda i: [i]), lambda o, e: CASE
                       WHEN {_drawn(str(seed), "bucket", "e[1]")} % (e[1] + 1) = e[1] THEN o || e
                       ELSE o[1:{_drawn(str(seed), "bucket", "e[1]")} % (e[1] + 1)] || e || o[{_drawn(str(seed), "bucket", "e[1]")} % (e[1] + 1) + 2:]
                            || [o[{_drawn(str(seed), "bucket", "e[1]")} % (e[1] + 1) + 1]] END) AS o
            FROM l
        ), p AS (
            SELECT total // {shards} AS each, total % {shards} AS longer, unnest(list_transform(o, lambda i: g[i + 1])) AS r,
                   CAST(start + unnest(range(len(o))) AS BIGINT) AS place
            FROM f
        ), q AS (
            SELECT *, CASE WHEN place < longer * (each + 1) THEN place // (each + 1)
                           ELSE longer + (place - longer * (each + 1)) // greatest(each, 1) END AS shard
            FROM p)
        SELECT r.doc_id AS doc_id, r.size AS size, CAST(r.crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
               CAST(place - shard * each - least(shard, longer) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
        FROM q"""


def _paid(way: str, cost: str, letter: str) -> str:
    """A way, its cost in nine digits before its audit, with one more edit; ways compare as strings."""
    return f"(lpad(CAST(CAST(substr({way}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}')"


def conversation_repair() -> str:
    b, s, u, a = (f"w[{k}]" for k in range(1, 5))
    more = "CASE e[2] WHEN 'c' THEN 5 ELSE 0 END"
    stays = "e[2] <> 'm'"
    kept = lambda way, initial: f"CASE WHEN {stays} AND e[1] = '{initial}' THEN {_paid(way, more, 'K')} END"
    again = lambda way: f"CASE WHEN {stays} THEN {_paid(way, f'1 + {more}', 'R')} END"
    gone = lambda way: _paid(way, "2", "D")
    new = lambda way: _paid(way, "5", "I")
    step = f"""CASE WHEN e[2] = '+' THEN [{b}, {s}, least({u}, {new(b)}, {new(s)}, {new(a)}), least({a}, {new(u)})] ELSE [
                {gone(b)}, least({gone(s)}, {kept(b, "s")}),
                least({gone(u)}, {again(b)}, {again(s)}, {again(a)}, {kept(b, "u")}, {kept(s, "u")}, {kept(a, "u")}),
                least({gone(a)}, {again(u)}, {kept(u, "a")})] END"""
    crc = f"list_reduce(list_transform(string_split(key, ''), lambda x: ascii(x)), lambda crc, v: {_EIGHT.format('xor(crc, v)')}, CAST(4294967295 AS BIGINT))"
    return f"""
        WITH k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
            FROM conversations
        ), d AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM k),
        m AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS nr
            FROM d
        ), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn FROM m),
        g AS (
            SELECT *, substr(role, 1, 1) AS initial,
                   regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS last,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) || substr(role, 1, 1) AS pair
            FROM r
        ), x AS (
            SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM g
        ), c AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                   count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   list_reduce(
                       [['', '+'], ['', '+']] || flatten(list([[initial, CASE fault WHEN 'blank' THEN 'm' WHEN 'duplicate' THEN 'm' WHEN 'truncated' THEN 'c' ELSE 'k' END],
                                                               ['', '+'], ['', '+']] ORDER BY rn)),
                       lambda w, e: {step}, ['000000000', NULL, NULL, NULL]) AS ways
            FROM x GROUP BY conv_id
        ), w AS (SELECT *, CAST(substr(least(ways[1], ways[4]), 1, 9) AS BIGINT) AS cost, substr(least(ways[1], ways[4]), 10) AS audit FROM c),
        l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(1, length(audit) + 1)) AS spot FROM w WHERE audit <> ''),
        p AS (
            SELECT *, sum(CAST(letter <> 'I' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY spot) AS rn,
                   sum(CAST(letter <> 'D' AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY spot) AS said
            FROM l
        ), t AS (
            SELECT p.conv_id, spot, said, letter, initial, role, text,
                   max(CASE WHEN said = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS system
            FROM p LEFT JOIN x ON p.conv_id IS NOT DISTINCT FROM x.conv_id AND p.rn = x.rn WHERE letter <> 'D'
        ), o AS (
            SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE (said - system) % 2 WHEN 1 THEN 'user' ELSE 'assistant' END END
                                       || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY spot) AS whole
            FROM t GROUP BY conv_id
        ), e AS (SELECT DISTINCT conv_id FROM conversations)
        SELECT e.conv_id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
               sha256(coalesce(whole, '')) AS repaired_sha256
        FROM e LEFT JOIN w ON e.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN o ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""
