"""SQL checks for the operators that SQL can express, over the same whole tables."""

_WORD = r"'[^\x20\x09-\x0D]+'"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEADS = " || ' ' || ".join(f"lead(word, {i}) OVER o" for i in range(1, 8))

LINE_DEDUP = rf"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
parts AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM rows WHERE text IS NOT NULL),
lines AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM parts),
hashed AS (SELECT *, CASE WHEN length(line) >= 99 AND len(regexp_extract_all(line, {_WORD})) >= 50 THEN -1
    ELSE ('0x' || substr(md5(line), 1, 7))::BIGINT END AS h FROM lines),
before AS (SELECT *, lag(h) OVER w AS h1, lag(h, 2) OVER w AS h2 FROM hashed WINDOW w AS (PARTITION BY rid ORDER BY i)),
cut AS (SELECT *, sum(CASE WHEN i = 0 OR h = -1 OR h1 = -1 OR (h1 + 31 * coalesce(h2, 0)) % 3 = 0 THEN 1 ELSE 0 END)
    OVER (PARTITION BY rid ORDER BY i) AS place FROM before),
chunks AS (SELECT rid, doc_id, place, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM cut GROUP BY ALL),
judged AS (SELECT *, CASE WHEN n > 1 THEN length(chunk) + n - 1 >= 40
    ELSE length(chunk) >= 99 AND len(regexp_extract_all(chunk, {_WORD})) >= 50 END AS able FROM chunks),
marked AS (SELECT *, able AND row_number() OVER (PARTITION BY chunk, able ORDER BY doc_id NULLS LAST, place) > 1 AS again FROM judged),
built AS (SELECT rid, count(*) AS n_chunks, count(*) FILTER (again) AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY place) FILTER (NOT again), '') AS new_text FROM marked GROUP BY rid)
SELECT doc_id, new_text AS text, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_removed, 0) AS n_removed
FROM rows LEFT JOIN built USING (rid)"""

QUALITY_RULES = rf"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
worded AS (SELECT *, regexp_extract_all(text, {_WORD}) AS words,
    list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, {_WORD})) AS ls FROM rows),
tokens AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM worded),
wide AS (SELECT rid, i, word || ' ' || {_LEADS} AS eight FROM tokens WINDOW o AS (PARTITION BY rid ORDER BY i)),
windows AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, eight) AS n FROM wide WHERE eight IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM
    (SELECT rid, unnest(range(i, i + 8)) AS p FROM windows WHERE n > 1) GROUP BY rid),
measured AS (SELECT rid, doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper FROM worded LEFT JOIN covered USING (rid)),
judged AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM measured)
SELECT * EXCLUDE (rid), (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM judged"""

MIXING = rf"""
WITH sized AS (SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), {_WORD}))::BIGINT AS size FROM documents),
keyed AS (SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(concat_ws(':', '7', doc_id, md5(text))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)
    / greatest(0.25::DOUBLE, 1.0::DOUBLE - coalesce(length(text) - length(translate(text, '#*$%&|<>', '')), 0)::DOUBLE
      / greatest(size, 1)::DOUBLE) AS e FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w,
    sum(source_size) OVER () AS total FROM sources),
tested AS (SELECT *, 3 * source_size * sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    <= w * (total - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    AS capped FROM ranked),
targets AS (SELECT source, source_size, CASE WHEN total = 0 THEN 0.0 WHEN capped THEN (3 * source_size)::DOUBLE ELSE w::DOUBLE
    * (total - coalesce(sum(3 * source_size) FILTER (capped) OVER (), 0))::DOUBLE / (sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target
    FROM tested),
placed AS (SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY keyed.source ORDER BY e / (e + 1.0::DOUBLE), doc_id NULLS FIRST, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM keyed JOIN targets ON keyed.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN 2 * start + size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM placed"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), {_WORD}) AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM worded)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
groups AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN groups USING (doc_id)"""

URL_RULES = r"""
WITH rules AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) AS t(v, h, p)),
parts AS (SELECT row_number() OVER () AS rid, page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
best AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v FROM parts JOIN rules
    ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN contains(host, 'cheap-pills') OR contains(host, 'spam-farm')
    OR contains(host, 'casino') THEN 'block' ELSE 'allow' END) AS verdict FROM parts LEFT JOIN best USING (rid)"""

# CRC-32 of a string: the table of the polynomial, then byte by byte.
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce([n] || range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce([4294967295] || list_transform(regexp_extract_all(hex(encode({text})), '..'),
        lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])))"""


def _draw(name: str, weight: str) -> str:
    digits = f"('0x' || substr(md5(concat(id, ':', {name})), 1, 12))::BIGINT::DOUBLE"
    return f"-ln(({digits} + 0.5) / 281474976710656.0::DOUBLE) / {weight}"


SHARDS = rf"""
WITH {_CRC_TABLE},
rows AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS id, coalesce(text, '') AS t FROM documents),
sized AS (SELECT rid, doc_id, id, (strlen(t) + 8)::BIGINT AS size, {_crc('t')}::BIGINT AS text_crc32 FROM rows, crc_table),
regions AS (SELECT rid, id, arg_min(r, draw) FILTER (r < 3) AS region, arg_min(r, draw) AS grown FROM
    (SELECT rid, id, r, {_draw('r', 'CASE WHEN r < 3 THEN 8.0::DOUBLE ELSE 1.0::DOUBLE END')} AS draw FROM sized, range(4) AS t(r)) GROUP BY rid, id),
racks AS (SELECT rid, id, region, grown, arg_min(k, draw) AS rack FROM
    (SELECT *, {_draw("region, '/', k", '4.0::DOUBLE')} AS draw FROM regions, range(2) AS t(k)) GROUP BY rid, id, region, grown),
leaves AS (SELECT rid, region, grown, rack, arg_min(s, draw) AS leaf FROM
    (SELECT *, {_draw("region, '/', rack, '/', s", '1.0::DOUBLE')} AS draw FROM racks, range(4) AS t(s)) GROUP BY rid, region, grown, rack),
placed AS (SELECT sized.*, region::INT AS region, rack::INT AS rack, (8 * region + 4 * rack + leaf)::INT AS shard, grown FROM sized JOIN leaves USING (rid))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard
    ORDER BY substr(md5(concat(id, ':', text_crc32)), 1, 16), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
    CASE WHEN grown = 3 THEN 24 ELSE shard END AS grown_shard, region, rack FROM placed"""

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
f AS (SELECT lang, 1 AS k, p, count(*) AS n FROM (SELECT lang, unnest(w) AS p FROM worded) GROUP BY ALL
    UNION ALL SELECT lang, 2, p, count(*) FROM
        (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: concat_ws(' ', w[i], w[i + 1]))) AS p FROM worded) GROUP BY ALL
    UNION ALL SELECT lang, 3, p, count(*) FROM
        (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS p FROM worded) GROUP BY ALL),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, p, string_split(p, ' ') AS w, n AS a FROM f WHERE k > 1 AND n >= 10),
longer AS (SELECT lang, p, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS p FROM candidates WHERE k = 3) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, p) WHERE longer.a IS NULL OR 100 * longer.a < 50 * c.a),
cuts AS (SELECT lang, p, a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM kept, range(1, 3) AS t(cut) WHERE cut < k),
scored AS (SELECT cuts.lang, cuts.p, a, cut, l.n AS l, r.n AS r,
    ((1000000::HUGEINT * a * a) // (l.n::HUGEINT * r.n))::BIGINT AS score
    FROM cuts JOIN f l ON l.lang = cuts.lang AND l.p = x JOIN f r ON r.lang = cuts.lang AND r.p = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1)
SELECT lang, rank, p AS phrase, a, l, r, n, score FROM
    (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank FROM lowest) JOIN totals USING (lang) WHERE rank <= 2000"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({_LOWER}, '[a-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM counted, crc_table),
written AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT x.word AS a, y.word AS b FROM cuts x JOIN cuts y ON x.cut = y.cut AND x.i = y.i WHERE x.word <> y.word
    UNION SELECT cuts.word, words.word FROM cuts JOIN words ON cut = words.word
    UNION SELECT words.word, cuts.word FROM cuts JOIN words ON cut = words.word),
best AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near FROM near JOIN words ON b = word
    QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
formed AS (SELECT word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best.n >= 10 * words.n THEN b END AS form,
    CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n FROM words LEFT JOIN best ON a = word),
chain AS (SELECT word, form AS root, 1 AS step FROM formed WHERE form IS NOT NULL
    UNION ALL SELECT chain.word, formed.form, step + 1 FROM chain JOIN formed ON root = formed.word WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)"""

ORACLES: dict[str, str] = {
    "op3_line_dedup": LINE_DEDUP,
    "op4_quality_rules": QUALITY_RULES,
    "op5_mixing": MIXING,
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op9_url_rules": URL_RULES,
    "op11_shards": SHARDS,
    "op12_collocations": COLLOCATIONS,
    "op13_spelling_variants": SPELLING,
}
