"""The operators that SQL expresses, for DuckDB."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT doc_id, n, pos, substr(h, 2 * pos + 1, 2) AS b, CASE WHEN pos + 100 <= n THEN substr(h, 2 * pos + 1, 200) END AS w FROM (SELECT doc_id, h, n, unnest(range(n)) AS pos FROM d)),
f AS (SELECT doc_id, pos, b, w IS NOT NULL AND min(doc_id * 10000000 + pos) OVER (PARTITION BY w) < doc_id * 10000000 + pos AS again FROM p),
c AS (SELECT doc_id, pos, b, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM f),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM c),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(b, '' ORDER BY pos) FILTER (WHERE NOT gone) AS rest FROM s GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

WORDS = r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, pos, w[pos] AS word, CASE WHEN pos + 12 <= len(w) THEN array_to_string(w[pos:pos + 12], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
f AS (SELECT doc_id, pos, word, x IS NOT NULL AND min(doc_id) OVER (PARTITION BY x) < doc_id AS again FROM p),
c AS (SELECT doc_id, pos, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (WHERE NOT gone) AS rest FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

BENCHMARK = rf"""WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT n FROM x) WHERE s + n - 1 <= len(w)),
m AS (SELECT doc_id, s, n, item FROM p JOIN x USING (n, x)),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS q FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

NEAR = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS (SELECT a, b FROM (SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS k FROM s l JOIN s r ON l.x = r.x AND l.doc_id <> r.doc_id GROUP BY 1, 2) JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * k >= 85 * (u.n + v.n - k)),
c AS (SELECT a AS node, b AS other FROM e UNION SELECT c.node, e.b FROM c JOIN e ON c.other = e.a),
m AS (SELECT node, min(other) AS least FROM c GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id, d.doc_id <= coalesce(least, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON node = d.doc_id"""


QUALITY = r"""WITH d AS (SELECT doc_id, lang, text IS NULL AS absent, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, pos, CASE WHEN pos + 4 <= len(w) THEN array_to_string(w[pos:pos + 4], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d)),
f AS (SELECT doc_id, pos, x IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, x) > 1 AS twice FROM p),
h AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM f),
r AS (SELECT doc_id, count(*) FILTER (WHERE hit) AS n FROM h GROUP BY 1),
b AS (SELECT d.*, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(r.n, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
k(i, sign) AS (VALUES (0, '[^A-Z]'), (1, '[^0-9]'), (2, '[^.,;:!?''\x22()\x2D]'), (3, '[^#*$%&|<>]'), (4, '[\x00-\x7F]'), (5, '[^\x20\x09-\x0D]')),
c AS (SELECT doc_id, lang, absent, i, length(regexp_replace(t, sign, '', 'g')) AS n, length(t) AS size FROM d, k),
cs AS (SELECT lang, i, sum(n) / sum(size) AS q FROM c WHERE lang IS NOT NULL AND NOT absent GROUP BY 1, 2 HAVING sum(size) > 0),
cq AS (SELECT lang, i, q FROM cs UNION ALL SELECT lang, 6, greatest(0, 1 - sum(q)) FROM cs GROUP BY 1),
cp AS (SELECT doc_id, i, n / size AS p FROM c WHERE size > 0 UNION ALL SELECT doc_id, 6, greatest(0, 1 - sum(n / size)) FROM c WHERE size > 0 GROUP BY 1),
v AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(t), '[^\x20\x09-\x0D]+')) AS word FROM d WHERE lang IS NOT NULL AND NOT absent) GROUP BY 1, 2),
tot AS (SELECT lang, sum(n) AS n FROM v GROUP BY 1),
top AS (SELECT lang, word, n FROM v QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 20),
voc AS (SELECT DISTINCT word FROM top),
ws AS (SELECT tot.lang, voc.word, coalesce(top.n, 0) / tot.n AS q FROM tot CROSS JOIN voc LEFT JOIN top ON top.lang = tot.lang AND top.word = voc.word),
wq AS (SELECT lang, word, q FROM ws UNION ALL SELECT lang, '', greatest(0, 1 - sum(q)) FROM ws GROUP BY 1),
dw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(w, lambda x: lower(x))) AS word FROM d) JOIN voc USING (word) GROUP BY 1, 2),
ds AS (SELECT b.doc_id, voc.word, coalesce(dw.n, 0) / n_words AS p FROM b CROSS JOIN voc LEFT JOIN dw ON dw.doc_id = b.doc_id AND dw.word = voc.word WHERE n_words >= 50),
wp AS (SELECT doc_id, word, p FROM ds UNION ALL SELECT doc_id, '', greatest(0, 1 - sum(p)) FROM ds GROUP BY 1),
cd AS (SELECT doc_id, min(x) AS x FROM (SELECT doc_id, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM cp JOIN cq USING (i) GROUP BY 1, 2) GROUP BY 1),
wd AS (SELECT doc_id, min(x) AS x FROM (SELECT doc_id, lang, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2)) AS x FROM wp JOIN wq USING (word) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT b.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN n_words >= 50 AND NOT (100 * n_repeat_words > 20 * n_words) THEN round(cd.x, 6) END AS class_distance, CASE WHEN NOT (100 * n_repeat_words > 20 * n_words) THEN round(wd.x, 6) END AS word_distance
 FROM b LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance,
 NOT base_failed AND coalesce(class_distance, 0) <= 0.25 AND coalesce(word_distance, 0) <= 0.45 AS kept FROM j"""

#: crc32 goes bit by bit; grams of equal counts stand in the order of their codes: one letter, three, two.
LANGUAGE = r"""WITH d AS (SELECT doc_id, lang, text, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda i: (ord(c) >> i) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))) AS crc FROM documents),
f AS (SELECT doc_id, lang, text, 3 - crc % 4 AS fold FROM d),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM f) GROUP BY 1, 2),
g AS (SELECT doc_id, gram, sum(n) AS n FROM (SELECT doc_id, n, unnest(list_concat(string_split(word, ''), list_transform(range(1, length(word) + 2), lambda i: substr(' ' || word || ' ', i, 2)), list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3)))) AS gram FROM w) GROUP BY 1, 2),
p AS (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, (length(gram) + 1) % 3 = 0, length(gram), gram) AS r FROM g QUALIFY r <= 300),
l AS (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, (length(gram) + 1) % 3 = 0, length(gram), gram) AS r FROM g JOIN f USING (doc_id) WHERE fold <> 2 AND lang IS NOT NULL GROUP BY lang, gram QUALIFY r <= 300),
k AS (SELECT doc_id, count(*) AS size FROM p GROUP BY 1),
m AS (SELECT doc_id, lang, sum(300 - abs(p.r - l.r)) AS near FROM p JOIN l USING (gram) GROUP BY 1, 2),
a AS (SELECT doc_id, x.lang, 300 * size - coalesce(near, 0) AS apart, 300 * size AS most FROM k CROSS JOIN (SELECT DISTINCT lang FROM l) x LEFT JOIN m USING (doc_id, lang)),
o AS (SELECT doc_id, lang, apart, coalesce(lead(apart) OVER (PARTITION BY doc_id ORDER BY apart, lang), most) AS other, row_number() OVER (PARTITION BY doc_id ORDER BY apart, lang) AS r FROM a)
SELECT doc_id, coalesce(fold = 2, false) AS held_out, coalesce(o.lang, 'und') AS lang_pred, CASE WHEN other > 0 THEN CAST(other - apart AS DOUBLE) / CAST(other AS DOUBLE) ELSE 0.0 END AS score FROM f LEFT JOIN (SELECT * FROM o WHERE r = 1) o USING (doc_id)"""

#: A row's number goes through four rounds at a time, and again while it is outside of the table.
SHARDS = r"""WITH RECURSIVE t AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS crc FROM range(256) r(i)),
d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, row, n, list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, row, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) AS crc FROM b, t),
s AS (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS side FROM (SELECT count(*) AS n FROM documents)),
p AS (SELECT row, row // side AS l, row % side AS r, 0 AS k FROM c, s UNION ALL SELECT row, r, (l + CAST('0x' || substr(md5('1:' || k % 4 || ':' || r), 1, 15) AS BIGINT) % side) % side, k + 1 FROM p, s WHERE k % 4 <> 0 OR k = 0 OR l * side + r >= n)
SELECT doc_id, c.n + 1 AS size, crc AS text_crc32, 'rows' AS law, CAST((l * side + r) % 16 AS INT) AS shard, (l * side + r) // 16 AS slot, CAST(NULL AS INT) AS grown_shard FROM c JOIN p USING (row), s WHERE k > 0 AND k % 4 = 0 AND l * side + r < s.n"""

PHRASES = rf"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d), t AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
c AS (SELECT lang, m, phrase, count(*) AS f FROM (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM p, range(1, 6) r(m) WHERE i + m - 1 <= len(w)) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
k AS (SELECT lang, m, phrase, f, string_split(phrase, ' ') AS w FROM c WHERE m > 1),
s AS (SELECT k.lang, k.phrase, k.f AS a, j AS k, h.f AS l, e.f AS r, n, CAST(1000::HUGEINT * k.f * n // (h.f::HUGEINT * e.f) AS BIGINT) AS score FROM k JOIN range(1, 5) x(j) ON j < k.m
 JOIN c h ON h.lang = k.lang AND h.phrase = array_to_string(k.w[1:j], ' ') JOIN c e ON e.lang = k.lang AND e.phrase = array_to_string(k.w[j + 1:], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
g AS (SELECT lang, phrase FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.lang = b.lang AND len(k.w) > len(string_split(b.phrase, ' ')) AND contains(' ' || k.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * k.f >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b JOIN g USING (lang, phrase)) WHERE rank <= 2000"""


def urls(rules: list[tuple[str, str]], listed: list[str]) -> str:
    """Longest rule first, else the list."""
    fits = [(f"((host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}'))", r, a) for a, r in sorted(rules, key=lambda x: -len(x[1]))]
    names = " ".join(f"WHEN {f} THEN '{r}'" for f, r, _ in fits)
    verdicts = " ".join(f"WHEN {f} THEN '{a}'" for f, _, a in fits)
    keys = ", ".join(f"'{x}'" for x in listed)
    return f"""WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u), p AS (SELECT page_id, translate(raw, {AZ}) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v)
SELECT page_id, host, path, CASE {names} END AS rule, CASE {verdicts} WHEN array_to_string(string_split(host, '.')[-3:], '.') IN ({keys}) THEN 'block' ELSE 'allow' END AS verdict FROM p"""
