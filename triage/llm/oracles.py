"""The same results as DuckDB SQL, where SQL can state them."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# A-Z to lower case; other letters stay.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op3_exact_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_KEY = _LOWER.format("regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', '')")
ORACLES["op6_line_dedup"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), split AS (
    SELECT row_no, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM docs
), keyed AS (
    SELECT *, {_KEY} AS key FROM split
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN frequent f ON k.key = f.key
GROUP BY row_no
"""

ORACLES["op8_warc_bundles"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), k AS (
    SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS keeper FROM p
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM keeper THEN NULL ELSE keeper END AS refers_to
FROM k
"""

# The patterns as the contract spells them; those of the added kinds with word boundaries.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "tel": r"(?:\([2-9][0-9]{2}\)\x20?|\b[2-9][0-9]{2}[\x20.-])[2-9][0-9]{2}[\x20.-][0-9]{4}\b",
    "ipv6": r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b",
    "key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}\b|gh[oprsu]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}"
    r"|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}"
    r"|[prs]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN\x20(?:[A-Z]{2,9}\x20)?PRIVATE\x20KEY(?:\x20BLOCK)?-----"
    r"(?:[^-]*-----END\x20(?:[A-Z]{2,9}\x20)?PRIVATE\x20KEY(?:\x20BLOCK)?-----)?",
    "password": r"(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]assphrase|[Pp]wd|[Ss]ecret|SECRET|[Aa]pi[_-]?[Kk]ey|API_?KEY"
    r"|[Aa]ccess[_-]?[Kk]ey|ACCESS_KEY|[Tt]oken|TOKEN)[\x22\x27]?(?:\x20?[:=]\x20?|\x20is\x20)[\x22\x27]?"
    r"[A-Za-z0-9_!@#$%^&*+=./?~-]{6,}",
    "token": r"[A-Za-z0-9_/+-]{24,}",
}
_FOUND = "\n    UNION ALL ".join(
    f"SELECT row_no, t, '{kind}' AS kind, {rank} AS rank, regexp_extract_all(t, '{pattern}') AS ms, "
    f"string_split_regex(t, '{pattern}') AS gaps FROM docs"
    for rank, (kind, pattern) in enumerate(_PATTERNS.items())
)
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: "
    f"CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INTEGER) "
    f"WHEN CAST(reverse({_DIGITS})[i] AS INTEGER) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) - 9 "
    f"ELSE 2 * CAST(reverse({_DIGITS})[i] AS INTEGER) END)) % 10 = 0"
)
_IBAN = (
    "list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), "
    "lambda c: ascii(c) - 48), lambda a, c: CASE WHEN c < 10 THEN (a * 10 + c) % 97 ELSE (a * 100 + c - 7) % 97 END, 0) = 1"
)
_VALUE = "regexp_extract(m, '^[A-Za-z_-]+[\\x22\\x27]?(?:\\x20?[:=]\\x20?|\\x20is\\x20)[\\x22\\x27]?(.*)$', 1)"


def _mixed(word: str, bits: float) -> str:
    """A letter, a digit and so many bits per character."""
    times = f"(length({word}) - length(replace({word}, c, '')))"
    return (
        f"regexp_matches({word}, '[0-9]') AND regexp_matches({word}, '[A-Za-z]') AND log2(length({word})) - list_sum("
        f"list_transform(list_distinct(string_split({word}, '')), lambda c: {times} * log2({times}))) / length({word}) >= {bits}"
    )


def _near(words: str) -> str:
    before = "lower(substr(t, greatest(start - 40, 0) + 1, start - greatest(start - 40, 0)))"
    return f"regexp_matches({before}, '(?:^|[^a-z0-9_])(?:{words})')"


ORACLES["op7_pii"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS t FROM documents
), found AS (
    {_FOUND}
), listed AS (
    SELECT row_no, t, kind, rank, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i
    FROM found WHERE len(ms) > 0
), placed AS (
    SELECT *, CAST(sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS start FROM listed
    WINDOW w AS (PARTITION BY row_no, kind ORDER BY i)
), good AS (
    SELECT row_no, kind, rank, start, start + length(m) AS stop, kind || ':' || start || ':' || (start + length(m)) AS span
    FROM placed
    WHERE CASE kind
        WHEN 'email' THEN true
        WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda p: CAST(p AS DOUBLE))) <= 255
        WHEN 'card' THEN length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}
        WHEN 'phone' THEN length({_DIGITS}) BETWEEN 10 AND 15
        WHEN 'iban' THEN length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_IBAN}
        WHEN 'ssn' THEN NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$') AND {_near('ssn|social|security')}
        WHEN 'tel' THEN NOT regexp_matches({_DIGITS}, '^(?:.11|....11)')
            AND {_near('phone|call|tel|mobile|cell|fax|contact|reach')}
        WHEN 'key' THEN regexp_matches(m, '[0-9]')
        WHEN 'password' THEN {_mixed(_VALUE, 2.2)}
        WHEN 'token' THEN {_mixed('m', 3.3)} AND {_near('[a-z0-9_-]*(?:key|token|secret|passw|credential|bearer)')}
        ELSE true END
), outer_ AS (
    SELECT * FROM good s WHERE rank < 4 OR NOT EXISTS (
        SELECT 1 FROM good o WHERE o.row_no = s.row_no AND o.rank < s.rank AND o.start <= s.start AND o.stop >= s.stop)
)
SELECT any_value(d.doc_id) AS doc_id,
       count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip,
       count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (WHERE rank < 4), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM docs d LEFT JOIN outer_ g ON d.row_no = g.row_no
GROUP BY d.row_no
"""

_TERMS = (
    "regexp_extract_all(" + _LOWER.format("coalesce(text, '')")
    + ", '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)
ORACLES["op11_ranked_search"] = f"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id, {_TERMS} AS terms FROM documents
), items AS (
    SELECT row_number() OVER () AS item_no, item_id, {_TERMS} AS terms FROM benchmark
), sums AS (
    SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS length FROM docs WHERE len(terms) > 0
), asked AS (
    SELECT item_no, term, count(*) AS times FROM (SELECT item_no, unnest(terms) AS term FROM items) GROUP BY ALL
), held AS (
    SELECT row_no, n, term, count(*) AS tf
    FROM (SELECT row_no, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs)
    WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM held, sums GROUP BY term
), scored AS (
    SELECT item_no, row_no,
           CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // length)))) AS BIGINT) AS score
    FROM held JOIN asked USING (term) JOIN weights USING (term), sums GROUP BY ALL
), ranked AS (
    SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id, row_no) AS INTEGER) AS rank
    FROM scored JOIN docs USING (row_no) JOIN items USING (item_no) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

# crc32 has no function there: a fold over bytes and bits.
ORACLES["op12_periodic_runs"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS row_no, doc_id,
           list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
           xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
               string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END),
               4294967295) AS h
    FROM documents
), placed AS (
    SELECT *, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM docs
), changed AS (
    SELECT row_no, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END])
        ELSE w END AS w FROM placed
), words AS (
    SELECT row_no, n, unnest(range(n)) AS i, unnest(w) AS word FROM changed
), pairs AS (
    SELECT y.row_no, y.i - x.i AS lag, y.i
    FROM words x JOIN words y ON x.row_no = y.row_no AND x.word = y.word AND x.i < y.i AND 4 * (y.i - x.i) <= y.n
), stretches AS (
    SELECT row_no, lag, min(i) - lag AS start, count(*) + lag AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY row_no, lag ORDER BY i) AS g FROM pairs)
    GROUP BY row_no, lag, g HAVING count(*) + lag >= greatest(6, 4 * lag)
), runs AS (
    SELECT row_no, start, length, min(lag) AS period FROM stretches GROUP BY ALL
), dropped AS (
    SELECT DISTINCT row_no, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
    SELECT w.row_no, string_agg(word, ' ' ORDER BY i) AS text FROM words w ANTI JOIN dropped d USING (row_no, i) GROUP BY w.row_no
), listed AS (
    SELECT row_no, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
    FROM runs GROUP BY row_no
), best AS (
    SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM changed c LEFT JOIN listed l ON c.row_no = l.row_no LEFT JOIN kept k ON c.row_no = k.row_no
LEFT JOIN best b ON c.row_no = b.row_no AND b.place = 1
"""
