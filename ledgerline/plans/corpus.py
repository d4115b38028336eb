"""Queries over whole documents and pages, each with SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html, jsonfix, periods
from ..operators import documents, extract, labels, mining, nearhash, phrases
from ..operators.joins import near_members
from ..streaming.merge import written
from .views import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


# Phrases

#: The first three words of each document: some 10,000 phrases in 10,000 documents.
_OPENINGS = r"""p AS (SELECT DISTINCT array_to_string(w[1:3], ' ') AS phrase FROM (
        SELECT list_filter(string_split_regex(lower(text), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents) WHERE len(w) > 2)"""
_FINDS = """h(doc_id, phrase, t, spot) AS (
        SELECT doc_id, phrase, lower(text), strpos(lower(text), phrase) - 1 FROM documents JOIN p ON contains(lower(text), phrase)
        UNION ALL SELECT doc_id, phrase, t, spot + strpos(substr(t, spot + 2), phrase) FROM h WHERE strpos(substr(t, spot + 2), phrase) > 0)"""


def _openings(spark, d):
    """Written once, as a dictionary is read for its size and for each of its shards."""
    # The first of five parts is empty if the text begins with white space; the last is all the rest.
    words = F.filter(F.split(F.lower("text"), r"\s+", 5), lambda w: w != "")
    found = table(spark, d, "documents").select(words.alias("w")).where("size(w) > 2").select(F.array_join(F.slice("w", 1, 3), " ").alias("phrase")).distinct()
    return written(found, "openings")


@query(f"WITH RECURSIVE {_OPENINGS}, {_FINDS} SELECT doc_id, phrase, CAST(spot AS INTEGER) AS \"offset\" FROM h")
def phrase_offsets_all(spark, d):
    return phrases.phrase_offsets(table(spark, d, "documents"), "doc_id", "text", _openings(spark, d))


@query(f"WITH RECURSIVE {_OPENINGS}, {_FINDS} SELECT doc_id, phrase, count(*) AS n, CAST(min(spot) AS INTEGER) AS first FROM h GROUP BY ALL HAVING count(*) > 0")
def phrase_counts(spark, d):
    found = phrases.phrase_offsets(table(spark, d, "documents"), "doc_id", "text", _openings(spark, d))
    return phrases.counts_by_phrase(found, "doc_id")


@query("""SELECT doc_id, len(regexp_extract_all(lower(text), 'the')) AS n, CAST(strpos(lower(text), 'the') - 1 AS INTEGER) AS first FROM documents WHERE contains(lower(text), 'the')""")
def keyword_offsets(spark, d):
    the = spark.createDataFrame([("The",)], "phrase string")
    found = phrases.phrase_offsets(table(spark, d, "documents"), "doc_id", "text", the)
    return phrases.counts_by_phrase(found, "doc_id").select("doc_id", "n", "first")


@query("""WITH p AS (SELECT unnest(['idiot', 'license', 'copyright']) AS phrase), h AS (SELECT doc_id, phrase FROM documents JOIN p ON contains(lower(text), phrase))
    SELECT doc_id, min(phrase) AS phrase FROM h GROUP BY ALL HAVING count(*) = 1""")
def keyword_attribution(spark, d):
    dictionary = spark.createDataFrame([("idiot", [], 1), ("license", [], 2), ("copyright", [], 3)], "phrase string, excludes array<string>, rank int")
    return phrases.attributed(table(spark, d, "documents").select("doc_id", "text"), dictionary, "text", "doc_id").select("doc_id", "phrase")


@query(f"""WITH {_OPENINGS}, h AS (SELECT doc_id, phrase FROM documents JOIN p ON contains(lower(text), phrase) WHERE NOT (length(phrase) % 3 = 0 AND contains(lower(text), 'license')))
    SELECT doc_id, min(phrase) AS phrase, CAST(length(min(phrase)) AS INTEGER) AS rank FROM h GROUP BY ALL HAVING count(*) = 1""")
def opening_attribution(spark, d):
    """Texts that hold one opening alone; a third of the openings don't count beside a license."""
    n = F.char_length("phrase")
    dictionary = _openings(spark, d).select("phrase", F.when(n % 3 == 0, F.array(F.lit("License"))).otherwise(F.array().cast("array<string>")).alias("excludes"), n.alias("rank"))
    return phrases.attributed(table(spark, d, "documents").select("doc_id", "text"), dictionary, "text", "doc_id")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(documents.text), lower(substr(b.text, 1, 60))) AND b.text <> '')")
def phrase_gate(spark, d):
    """Documents that hold the beginning of a benchmark item."""
    wanted = table(spark, d, "benchmark").select(F.substring("text", 1, 60).alias("phrase"))
    return phrases.holding_any(table(spark, d, "documents").select("doc_id", "text"), "text", wanted).select("doc_id")


# Near duplicates

_SIMHASH = r"""w AS (SELECT doc_id, lang, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9 \t\n\x0B\f\r]', '', 'g'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
    u AS (SELECT doc_id, md5(unnest(w)) AS m FROM w),
    n AS (SELECT doc_id, m, count(*) AS n FROM u GROUP BY ALL),
    v AS (SELECT doc_id, n, CAST('0x' || m[15:16] || m[13:14] || m[11:12] || m[9:10] || m[7:8] || m[5:6] || m[3:4] || m[1:2] AS UBIGINT) AS v FROM n),
    b AS (SELECT doc_id, i, sum(CASE WHEN (v >> i) & 1 = 1 THEN n ELSE -n END) AS s FROM v, (SELECT CAST(unnest(range(64)) AS UBIGINT) AS i) GROUP BY ALL),
    h AS (SELECT w.doc_id, lang, coalesce(sum(CASE WHEN s > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INTEGER) ELSE 0 END), 0) AS h FROM w LEFT JOIN b USING (doc_id) GROUP BY ALL),
    s AS (SELECT doc_id, lang, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS simhash FROM h),
    c AS (SELECT lang, simhash, min(doc_id) AS k, count(*) AS n FROM s WHERE lang IS NOT NULL GROUP BY ALL),
    p AS (SELECT a.k AS key_a, b.k AS key_b, bit_count(xor(a.simhash, b.simhash)) AS distance, a.n AS na, b.n AS nb FROM c a JOIN c b ON a.lang = b.lang AND a.k < b.k AND bit_count(xor(a.simhash, b.simhash)) <= 3)"""


def _near(spark, d):
    hashes = written(nearhash.simhash(table(spark, d, "documents"), ["doc_id", "lang"], "text"), "simhashes")
    pairs = written(nearhash.near_by_hamming(hashes, "doc_id", "lang", "simhash"), "near-pairs")
    return pairs, near_members(hashes, pairs, "doc_id", "lang", "simhash")


@query(f"WITH {_SIMHASH} SELECT key_a, key_b, CAST(distance AS INTEGER) AS distance FROM p UNION ALL SELECT k, doc_id, 0 FROM s JOIN c USING (lang, simhash) WHERE doc_id <> k")
def near_dup_docs(spark, d):
    """Pairs of representatives, and each other member of a class with its own at distance 0."""
    pairs, members = _near(spark, d)
    copies = members.where("doc_id <> representative").select(F.col("representative").alias("key_a"), F.col("doc_id").alias("key_b"), F.lit(0).alias("distance"))
    return pairs.union(copies)


@query(f"""WITH {_SIMHASH}, e AS (SELECT key_a AS k, nb AS n FROM p UNION ALL SELECT key_b, na FROM p), t AS (SELECT k, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY ALL)
    SELECT doc_id, lang, simhash, c.k AS representative, coalesce(c.n - 1 + coalesce(t.n, 0), 0) AS near FROM s LEFT JOIN c USING (lang, simhash) LEFT JOIN t ON t.k = c.k""")
def near_dup_members(spark, d):
    return _near(spark, d)[1].select("doc_id", "lang", "simhash", "representative", "near")


# Templates

_EDGE = r"[\p{Z}\s\x0B\x1C-\x1F\x{85}]"
_LINES = rf"""l AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(string_split_regex(text, '\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{{85}}\x{{2028}}\x{{2029}}]')), '^{_EDGE}+', ''), '{_EDGE}+$', '') AS line FROM documents),
    k AS (SELECT line, length(line) - length(replace(line, '|', '')) >= 2 OR regexp_matches(line, '[\p{{L}}\p{{N}}_\s]{{3,}}\s{{3,}}[\p{{Nd}},]{{1,10}}') AS is_table FROM l WHERE line <> '')"""
_MASKED = r"""regexp_replace({0}, '\b[0-9,]+\b', 'X', 'g')"""
_TABLES = rf"""t AS (SELECT trim(regexp_replace({_MASKED.format("regexp_replace(regexp_replace(line, '^[|]+' || '[ \\t]*', ''), '[ \\t]*' || '[|]+$', '')")}, ' {{2,}}', ' ', 'g')) AS template FROM k WHERE is_table)"""
_GRAMS = rf"""x AS (SELECT regexp_extract_all({_MASKED.format("lower(line)")}, '[a-z''X]+') AS w FROM k WHERE NOT is_table),
    g AS (SELECT array_to_string(w[i:i + s - 1], ' ') AS gram, s FROM (SELECT w, s, unnest(range(1, len(w) - s + 2)) AS i FROM x, (SELECT unnest([3, 4]) AS s) WHERE len(w) >= s))"""


@query(f"WITH {_LINES}, {_TABLES} SELECT template, count(*) AS n FROM t GROUP BY ALL HAVING count(*) >= 2")
def line_templates(spark, d):
    return mining.frequent(mining.table_templates(table(spark, d, "documents"), "text"))


@query(f"WITH {_LINES}, {_GRAMS} SELECT gram, count(*) AS n FROM g WHERE s = 3 GROUP BY ALL HAVING count(*) >= 5")
def frequent_ngrams(spark, d):
    return mining.frequent(mining.prose_ngrams(table(spark, d, "documents"), "text", (3,), "gram"), 5)


@query(f"WITH {_LINES}, {_GRAMS} SELECT gram, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2")
def frequent_ngrams_all(spark, d):
    return mining.frequent(mining.prose_ngrams(table(spark, d, "documents"), "text", name="gram"))


QUERIES["line_templates_all"], SQL["line_templates_all"] = line_templates, SQL["line_templates"]


@query(f"""WITH {_LINES}, {_TABLES}, {_GRAMS}, c AS (SELECT 'table' AS kind, template, count(*) AS frequency, 10 AS most FROM t GROUP BY ALL UNION ALL SELECT 'prose', gram, count(*), 15 FROM g GROUP BY ALL)
    SELECT kind, template, frequency FROM c WHERE frequency >= 2 QUALIFY row_number() OVER (PARTITION BY kind ORDER BY frequency DESC, template) <= most""")
def snippet_report(spark, d):
    return mining.report(table(spark, d, "documents"), "text")


# Windows

_FOLD = """WITH RECURSIVE c AS (
        SELECT doc_id, list(t ORDER BY hits DESC, i) AS l FROM (SELECT doc_id, t, i, (length(lower(t)) - length(replace(lower(t), 'the', ''))) // 3 AS hits FROM (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)) GROUP BY ALL
    ), s(doc_id, l, i, w, p, used, primary_one) AS (
        SELECT doc_id, l, 1, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0, true FROM c
        UNION ALL
        SELECT doc_id, l, i + 1,
            CASE WHEN NOT primary_one AND len(w) >= 3 THEN w WHEN length(l[i]) <= {0} - used THEN w
                WHEN NOT primary_one OR used < {0} THEN list_append(w, substr(array_to_string(CASE WHEN used < {0} THEN list_append(p, substr(l[i], 1, {0} - used)) ELSE p END, chr(10) || chr(10)), 1, {0}))
                WHEN length(l[i]) > {0} THEN list_concat(w, [substr(array_to_string(p, chr(10) || chr(10)), 1, {0}), substr(l[i], 1, {0})])
                ELSE list_append(w, substr(array_to_string(p, chr(10) || chr(10)), 1, {0})) END,
            CASE WHEN NOT primary_one AND len(w) >= 3 THEN p WHEN length(l[i]) <= {0} - used THEN list_append(p, l[i])
                WHEN NOT primary_one OR used < {0} OR length(l[i]) > {0} THEN CAST([] AS VARCHAR[]) ELSE [l[i]] END,
            CAST(CASE WHEN NOT primary_one AND len(w) >= 3 THEN used WHEN length(l[i]) <= {0} - used THEN used + length(l[i])
                WHEN NOT primary_one OR used < {0} OR length(l[i]) > {0} THEN 0 ELSE length(l[i]) END AS INTEGER),
            primary_one AND length(l[i]) <= {0} - used
        FROM s WHERE i <= len(l)
    ), f AS (
        SELECT doc_id, CASE WHEN primary_one OR len(p) > 0 AND len(w) < 3 THEN list_append(w, substr(array_to_string(p, chr(10) || chr(10)), 1, {0})) ELSE w END AS w FROM s WHERE i = len(l) + 1
    ), o AS (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS "window", unnest(w) AS said FROM f)
    SELECT doc_id, "window", length(said) AS chars, md5(said) AS digest FROM o"""


def _chunk_windows(budget):
    def run(spark, d):
        lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "line"))
        rows = documents.chunk_windows(lines, "doc_id", "n", "line", ["the"], budget)
        return rows.select("doc_id", "window", F.char_length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))

    return run


for _name, _budget in (("monthly", extract.MONTHLY_BUDGET), ("quarterly", extract.QUARTERLY_BUDGET)):
    QUERIES[f"chunk_windows_{_name}"], SQL[f"chunk_windows_{_name}"] = _chunk_windows(_budget), _FOLD.format(_budget)


_FILED = "CASE doc_id % 5 WHEN 0 THEN replace(text, ' the ', ' Item 7. ') WHEN 1 THEN 'Item 2. Item 3 ' || replace(text, ' of ', ' ITEM 2. ') WHEN 2 THEN replace(text, ' and ', ' Hash Rate ') WHEN 3 THEN replace(text, ' is ', ' Management''s Discussion ') ELSE coalesce(text, '') END"


@query(rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce({_FILED}, '') AS t FROM documents),
    m(doc_id, t, header, spot) AS (
        SELECT doc_id, t, h, strpos(lower(t), h) - 1 FROM t, (SELECT unnest(['item 7.', 'item 2.', 'management''s discussion']) AS h) WHERE contains(lower(t), h)
        UNION ALL SELECT doc_id, t, header, spot + strpos(substr(lower(t), spot + 2), header) FROM m WHERE strpos(substr(lower(t), spot + 2), header) > 0),
    l AS (SELECT doc_id, header, spot, length(regexp_extract(substr(t, spot + 11), '(?is)^(.*?)(?:\bitem\s+\d|$)', 1)) AS n FROM m),
    b AS (SELECT doc_id, arg_min(spot, (CASE header WHEN 'item 7.' THEN 1 WHEN 'item 2.' THEN 2 ELSE 3 END, spot)) AS spot FROM l WHERE n >= 300 GROUP BY ALL),
    k AS (SELECT doc_id, min(spot) AS spot FROM (SELECT doc_id, strpos(lower(t), unnest(['hash rate', 'hashrate', 'exahash', 'btc mined', 'bitcoin production'])) - 1 AS spot FROM t) WHERE spot >= 0 GROUP BY ALL),
    s AS (SELECT doc_id, t, CAST(greatest(0, coalesce(b.spot - 200, k.spot - 500, 0)) AS INTEGER) AS start, CASE WHEN b.spot IS NOT NULL THEN 'mda_header' WHEN k.spot IS NOT NULL THEN 'keyword_seek' ELSE 'start' END AS strategy
        FROM t LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id))
    SELECT doc_id, start, strategy, md5(substr(t, start + 1, 24000)) AS digest FROM s""")
def quarterly_windows(spark, d):
    """Documents in which some common words are headers and phrases of filings."""
    k, t = F.col("doc_id") % 5, F.col("text")
    swap = lambda a, b: F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    filed = (
        F.when(k == 0, swap("the", "Item 7.")).when(k == 1, F.concat(F.lit("Item 2. Item 3 "), swap("of", "ITEM 2."))).when(k == 2, swap("and", "Hash Rate"))
        .when(k == 3, swap("is", "Management's Discussion")).otherwise(t)
    )
    rows = extract.quarterly_window(table(spark, d, "documents").select("doc_id", filed.alias("text")), "doc_id", "text")
    return rows.select("doc_id", "start", "strategy", F.md5("text").alias("digest"))


# Periods

@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) + CASE o_orderkey % 6 WHEN 0 THEN INTERVAL 5 MONTH WHEN 1 THEN INTERVAL 5 MONTH WHEN 3 THEN INTERVAL 5 MONTH WHEN 5 THEN INTERVAL 2 MONTH ELSE INTERVAL 0 MONTH END AS DATE) AS month FROM orders""")
def body_period(spark, d):
    """A title's month against what the text says: a sure phrase after one that repeats
    the title, a lesser phrase, a bare month, both, a phrase too far down, two phrases."""
    k, spell = F.col("o_orderkey") % 6, lambda n: F.date_format(F.add_months("o_orderdate", n), "MMMM yyyy")
    title, other, third = spell(0), spell(5), spell(2)
    said = (
        F.when(k == 0, F.concat(F.lit("During "), title, F.lit(" little. In "), other, F.lit(" more")))
        .when(k == 1, F.concat(title, F.lit(" mining. "), other, F.lit("  PRODUCTION")))
        .when(k == 2, F.concat(F.lit("Founded "), other, F.lit(". Nothing else")))
        .when(k == 3, F.concat(third, F.lit(" results; for the  month of "), other))
        .when(k == 4, F.concat(F.repeat(F.lit("words "), 500), F.lit("in "), other))
        .otherwise(F.concat(F.lit("in "), third, F.lit(", then in "), other))
    )
    return table(spark, d, "orders").select("o_orderkey", periods.corrected_period(said, F.trunc("o_orderdate", "MM")).alias("month"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month FROM orders""")
def slug_period(spark, d):
    k, month, year = F.col("o_orderkey") % 5, F.date_format("o_orderdate", "MMMM"), F.date_format("o_orderdate", "yyyy")
    slug = F.concat_ws("-", F.lit("announces"), month, year)
    url = (
        F.when(k == 0, F.concat(F.lit("https://x.com/acme-"), F.lower(slug), F.lit("-production")))
        .when(k == 1, F.concat(F.lit("https://x.com/Acme-"), F.upper(slug)))
        .when(k == 2, F.concat(F.lit("https://x.com/announces-record-2019-b-"), slug, F.lit("-leap-month")))
        .when(k == 3, F.concat(F.lit("https://x.com/"), slug, F.lit("5")))
        .otherwise(F.concat(F.lit("https://x.com/announces-"), F.substring(month, 1, 3), F.lit("x-"), year))
    )
    return table(spark, d, "orders").select("o_orderkey", periods.slug_period(url).alias("month"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS month, CAST(CASE WHEN o_orderkey % 4 < 3 THEN 0.85 ELSE 0 END AS DOUBLE) AS confidence,
    CASE WHEN o_orderkey % 4 < 3 THEN 'rule_based' ELSE 'not_found' END AS method FROM orders""")
def undated_files(spark, d):
    """By the date in the name, by the month in it, by the body; a PDF's body doesn't count."""
    k, other = F.col("o_orderkey") % 4, F.date_format(F.add_months("o_orderdate", 5), "MMMM yyyy")
    named = F.date_format("o_orderdate", "MMMM yyyy")
    path = F.when(k == 0, F.concat(F.lit("/a/10-Q "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" for "), other, F.lit(".html"))).when(k == 1, F.concat(F.lit("/a/"), named, F.lit(".html"))).when(k == 2, "/a/update.HTML").otherwise("/a/update.pdf")
    body = F.when(k >= 2, F.concat(F.lit("Home. Results for the month of "), named)).otherwise(F.concat(F.lit("In "), other))
    found = periods.undated_period(path, body)
    return table(spark, d, "orders").select("o_orderkey", found.alias("f")).select("o_orderkey", F.col("f.period").alias("month"), "f.confidence", "f.method")


# Labels and answers

@query(r"""WITH n AS (SELECT p_partkey % 4 AS k, p_name, p_type, p_brand, p_name || ' ' || p_type || ' held' AS alias FROM part), a AS (SELECT alias, min(p_brand) AS metric, row_number() OVER (ORDER BY alias) AS rank FROM n GROUP BY alias),
    l AS (SELECT DISTINCT CASE k WHEN 0 THEN upper(alias) || '!!' WHEN 1 THEN 'total ' || alias || ' (BTC)' WHEN 2 THEN 'held x ' || p_type || ' y ' || split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) || '  ' || p_type END AS label FROM n),
    x AS (SELECT l.label, a.*, trim(regexp_replace(regexp_replace(lower(l.label), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS c, trim(regexp_replace(regexp_replace(lower(alias), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g')) AS q FROM l, a),
    s AS (SELECT *, CASE WHEN c = q THEN 1.0 WHEN contains(c, q) OR contains(q, c) THEN 0.85 ELSE len(list_intersect(list_distinct(string_split(c, ' ')), list_distinct(string_split(q, ' ')))) / len(list_distinct(string_split(q, ' '))) END AS score FROM x WHERE c <> '')
    SELECT label, metric, alias, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, rank) = 1""")
def label_metrics(spark, d):
    """Labels equal to an alias but for case, around one, of three of its four words
    and others, part of several."""
    part = table(spark, d, "part").withColumn("alias", F.concat_ws(" ", "p_name", "p_type", F.lit("held")))
    aliases = part.groupBy("alias").agg(F.min("p_brand").alias("metric")).withColumn("rank", F.col("alias"))
    k, name = F.col("p_partkey") % 4, F.split("p_name", " ")
    label = (
        F.when(k == 0, F.concat(F.upper("alias"), F.lit("!!")))
        .when(k == 1, F.concat(F.lit("total "), F.col("alias"), F.lit(" (BTC)")))
        .when(k == 2, F.concat(F.lit("held x "), F.col("p_type"), F.lit(" y "), name[0]))
        .otherwise(F.concat(name[1], F.lit("  "), F.col("p_type")))
    )
    return labels.best_metric(part.select(label.alias("label")), aliases)


@query("""SELECT o_orderkey, o_totalprice AS price, o_orderpriority AS priority, o_orderkey % 6 < 4 AS whole FROM orders""")
def mended_answers(spark, d):
    """Answers broken in six ways: talk around, single quotes, trailing commas, names
    without quotes, cut off in a list, cut off in an object."""
    k, price, said = F.col("o_orderkey") % 6, F.format_string("%.2f", "o_totalprice"), F.col("o_orderpriority")
    body = F.concat(F.lit('{"price": '), price, F.lit(', "priority": "'), said, F.lit('", "more": {"a": [1, 2], "end": true}}'))
    raw = (
        F.when(k == 0, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n``` done {")))
        .when(k == 1, F.replace(F.replace(body, F.lit('"'), F.lit("'")), F.lit("true"), F.lit("True")))
        .when(k == 2, F.replace(F.replace(body, F.lit("]"), F.lit(", ]")), F.lit("}"), F.lit(", }")))
        .when(k == 3, F.regexp_replace(body, r'"(\w+)":', "$1 :"))
        .when(k == 4, F.substring_index(body, ", 2", 1))
        .otherwise(F.substring_index(body, ": true", 1))
    )
    parsed = F.from_json(jsonfix.mended_json(raw), "price double, priority string, more struct<a: array<int>, `end`: boolean>")
    rows = table(spark, d, "orders").select("o_orderkey", parsed.alias("p"))
    return rows.select("o_orderkey", "p.price", "p.priority", F.coalesce(F.col("p.more.end"), F.lit(False)).alias("whole"))


# Pages

@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g') AS raw, regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g') AS head FROM pages),
    c AS (SELECT page_id, regexp_replace(trim(raw), '^[ |–—-]+|[ |–—-]+$', '', 'g') AS a, regexp_replace(trim(head), '^[ |–—-]+|[ |–—-]+$', '', 'g') AS b FROM t)
    SELECT page_id, CASE WHEN length(a) > 220 THEN rtrim(substr(a, 1, 217)) || '...' WHEN length(a) >= 8 THEN a WHEN length(b) > 220 THEN rtrim(substr(b, 1, 217)) || '...' WHEN length(b) >= 8 THEN b END AS title FROM c""")
def web_page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", html.document_title(F.col("html"), F.lit(None).cast("string")).alias("title"))
