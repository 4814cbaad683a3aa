"""The operators' results as DuckDB SQL, where SQL can express them."""

#: Windows of 50 bytes, as hex digits; cut out of blocks, since a cut far into a long string is slow.
OP3 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS body, strlen(coalesce(text, '')) AS n_bytes FROM documents
), blocks AS (
    SELECT r, doc_id, n_bytes, before, substr(body, 2 * before + 1, 610) AS part
    FROM (SELECT *, unnest(range(0, n_bytes - 49, 256)) AS before FROM d)
), windows AS (
    SELECT r, doc_id, before + k AS p, substr(part, 2 * k - 1, 100) AS bytes
    FROM (SELECT *, unnest(range(1, least(256, n_bytes - 49 - before) + 1)) AS k FROM blocks)
), gone AS (
    SELECT r, p FROM (SELECT r, p, doc_id, min(doc_id) OVER (PARTITION BY bytes) AS least FROM windows) WHERE doc_id > least
), spans AS (
    SELECT r, min(p) AS a, max(p) + 49 AS b
    FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS span
        FROM (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM gone))
    GROUP BY r, span
), kept AS (
    SELECT r, string_agg(substr(body, 2 * start - 1, greatest(2 * (stop - start + 1), 0)), '' ORDER BY start) AS bytes
    FROM (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a) + 1, 1) AS start, a - 1 AS stop FROM spans
        UNION ALL SELECT d.r, coalesce(max(b), 0) + 1, max(n_bytes) FROM d LEFT JOIN spans USING (r) GROUP BY d.r)
    JOIN d USING (r) GROUP BY r
), removed AS (
    SELECT r, sum(b - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(bytes)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN removed USING (r)
"""

#: Checksums by hex digits, the low one of each byte first; the numbers are CRC-32's fixed values for a digit.
#: Shards from the chain of jumps: the last below the number of shards.
OP4 = r"""
WITH RECURSIVE d AS (
    SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS body FROM documents
), digits AS (
    SELECT r, doc_id, octet_length(body)::BIGINT + 1 AS size,
        list_transform(string_split(regexp_replace(hex(body), '(.)(.)', '\2\1', 'g'), ''), lambda c: strpos('123456789ABCDEF', c)::BIGINT) AS digits
    FROM d
), sums AS (
    SELECT r, doc_id, size, CASE WHEN size = 1 THEN 0 ELSE xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, digits), lambda crc, x: xor(crc >> 4,
        ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::BIGINT[])[(xor(crc, x) & 15) + 1]))) END AS text_crc32
    FROM digits
), chain AS (
    SELECT r, CASE WHEN doc_id < 0 THEN 18446744073709551616::HUGEINT ELSE 0 END + coalesce(doc_id, 0) AS state, 0::BIGINT AS jump FROM d
    UNION ALL
    SELECT r, state, floor((jump + 1) * (2147483648::DOUBLE / ((state // 8589934592)::DOUBLE + 1)))::BIGINT
    FROM (SELECT r, (state * 2862933555777941757 + 1) % 18446744073709551616::HUGEINT AS state, jump FROM chain WHERE jump < 9)
), shards AS (
    SELECT r, max(jump) FILTER (jump < 8)::INTEGER AS shard, max(jump) FILTER (jump < 9)::INTEGER AS grown_shard FROM chain GROUP BY r
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard
FROM sums JOIN shards USING (r)
"""

#: Starts of matches from the lengths of the matches and of what lies between them. Runs of hex digits
#: are maximal, so those of 16 and more are the ones that count.
OP5 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), kinds (place, kind, pattern, part, least) AS (
    VALUES
    (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
    (1, 'access', 'AKIA[A-Z0-9]+', 0, 18),
    (2, 'hex', '[0-9a-f]{16,}', 0, 16)
), found AS (
    SELECT r, place, kind, least, regexp_extract_all(text, pattern) AS whole, regexp_extract_all(text, pattern, part) AS counted,
        string_split_regex(text, pattern) AS between
    FROM d, kinds
), spans AS (
    SELECT r, place, kind, least, i, len(counted[i]) AS n, len(whole[i]) AS width,
        sum(len(between[i]) + len(whole[i])) OVER (PARTITION BY r, place ORDER BY i) AS stop
    FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)
), said AS (
    SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || (stop - width) || ':' || stop, ',' ORDER BY stop - width, place) AS spans
    FROM spans WHERE n >= least GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN said USING (r)
"""

#: Items of five words and more by their distinct runs of five words; shorter ones by the run of all their words.
OP6 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT item_id, text FROM benchmark)
), ig AS (
    SELECT DISTINCT item_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
    FROM (SELECT item_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)
), k AS (
    SELECT DISTINCT k FROM ig
), dg AS (
    SELECT DISTINCT r, doc_id, k, array_to_string(w[p : p + k - 1], ' ') AS g
    FROM (SELECT r, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, k WHERE len(w) >= k)
), n AS (
    SELECT item_id, count(*) AS n_shingles FROM ig GROUP BY item_id
), s AS (
    SELECT r, doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM s JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_shingles - 1e-9)
"""

OP9 = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT r, p, [w[p], w[p + 1], w[p + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM d)
), twice AS (
    SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), rep AS (
    SELECT r, count(DISTINCT p + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), lines AS (
    SELECT r, l, count(*) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r, l
), dup AS (
    SELECT r, sum(n - 1)::BIGINT AS n, sum(n)::BIGINT AS n_lines FROM lines GROUP BY r
), f AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
        coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
    FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 100 * n_symbols <= 10 * n_words AND 100 * n_dup_lines <= 40 * n_lines
        AND word_chars BETWEEN 3 * n_words AND 10 * n_words AS kept
FROM b
"""

#: Of equal payloads of 1000 bytes or more, the largest page_id answers for all.
OP10 = """
WITH p AS (
    SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), w AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM p
)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND keeper <> page_id THEN keeper END AS refers_to
FROM w
"""

#: Units, the four draws, and the parts as lists of units; lists are cut as [first, last].
OP11 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
        regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
    FROM documents
), draws AS (
    SELECT doc_id, text, units, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
        ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM d
), cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM draws
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(list_slice(units, 1, a), '') AS p,
        array_to_string(list_slice(units, a + 1, b), '') AS m, array_to_string(list_slice(units, b + 1, n), '') AS s
    FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""
