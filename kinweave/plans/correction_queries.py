"""Queries over address and provider correction, tokens, vectors and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import privacy, text, vectors
from ..operators import correct, fuzzyjoin, geo
from .registry import query, table
from .table_queries import clean_sql

# ---- derived tables -----------------------------------------------------------------------------
#
# Customers stand in for address records: the nation is the city and the market segment the state,
# some of them misspelt. The reference list holds every true combination in key order.

_ADDRESSES = """
addresses AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 7 = 0 THEN left(n_name, 3) || substr(n_name, 5) ELSE n_name END AS city,
    CASE WHEN c_custkey % 11 = 0 THEN left(c_mktsegment, length(c_mktsegment) - 1) ELSE c_mktsegment END AS state
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
places AS (
  SELECT n_name AS city, seg AS state_id, n_name || ',' || seg AS city_state,
    n_nationkey * 100 + dense_rank() OVER (ORDER BY seg) AS ref_order
  FROM nation, (SELECT DISTINCT c_mktsegment AS seg FROM customer)),
unknown AS (
  SELECT DISTINCT city || ',' || state AS city_state FROM addresses
  WHERE city NOT IN (SELECT city FROM places) OR state NOT IN (SELECT state_id FROM places)),
close AS (
  SELECT u.city_state AS original, p.city_state AS suggested, levenshtein(u.city_state, p.city_state) AS edits, ref_order
  FROM unknown u, places p WHERE levenshtein(u.city_state, p.city_state) < 3),
suggestions AS (
  SELECT original, suggested, edits FROM close
  QUALIFY row_number() OVER (PARTITION BY original ORDER BY edits, ref_order) = 1)
"""


def _addresses(spark, d) -> DataFrame:
    nation = F.broadcast(table(spark, d, "nation"))  # 25 rows at every scale
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    city = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.left("n_name", F.lit(3)), F.expr("substring(n_name, 5)")))
    state = F.when(
        F.col("c_custkey") % 11 == 0, F.left("c_mktsegment", F.length("c_mktsegment") - 1)
    )
    return rows.select(
        "c_custkey",
        F.coalesce(city, "n_name").alias("city"),
        F.coalesce(state, "c_mktsegment").alias("state"),
    )


def _places(spark, d) -> DataFrame:
    """Every nation with every segment found with it; all 125 combinations occur in the data."""
    nation = table(spark, d, "nation")
    segments = table(spark, d, "customer").select(F.col("c_mktsegment").alias("state_id")).distinct()
    listed = segments.agg(F.sort_array(F.collect_set("state_id"))).scalar()  # five values
    rows = nation.withColumn("all", listed).select("*", F.posexplode("all").alias("pos", "state_id"))
    return rows.select(
        F.col("n_name").alias("city"),
        "state_id",
        F.concat_ws(",", "n_name", "state_id").alias("city_state"),
        (F.col("n_nationkey") * 100 + F.col("pos") + 1).cast("long").alias("ref_order"),
    )


@query("city_state_key", f"WITH {_ADDRESSES} SELECT c_custkey, city || ',' || state AS city_state FROM addresses")
def city_state_key(spark, d):
    return _addresses(spark, d).select("c_custkey", correct.city_state_key().alias("city_state"))


@query(
    "unknown_city_state",
    f"WITH {_ADDRESSES} SELECT DISTINCT city || ',' || state AS city_state FROM addresses WHERE city || ',' || state NOT IN (SELECT city_state FROM places)",
)
def unknown_city_state(spark, d):
    keyed = _addresses(spark, d).withColumn("city_state", correct.city_state_key())
    return correct.unknown_city_state(keyed, _places(spark, d))


@query("unknown_city_or_state", f"WITH {_ADDRESSES} SELECT city_state FROM unknown")
def unknown_city_or_state(spark, d):
    return correct.unknown_city_or_state(_addresses(spark, d), _places(spark, d))


def _suggestions(spark, d) -> DataFrame:
    unknown = correct.unknown_city_or_state(_addresses(spark, d), _places(spark, d))
    return correct.suggest_corrections(unknown, _places(spark, d), 3)


@query("suggest_corrections", f"WITH {_ADDRESSES} SELECT original, suggested, CAST(edits AS INTEGER) AS edits FROM suggestions")
def suggest_corrections(spark, d):
    return _suggestions(spark, d)


@query(
    "apply_corrections",
    f"""
WITH {_ADDRESSES},
good AS (SELECT * FROM suggestions WHERE original NOT LIKE '%,BUILDIN%')
SELECT c_custkey, coalesce(split_part(suggested, ',', 1), city) AS city, coalesce(split_part(suggested, ',', 2), state) AS state
FROM addresses LEFT JOIN good ON original = city || ',' || state
""",
)
def apply_corrections(spark, d):
    """Suggestions for one state name are turned down by the reviewer."""
    found = _suggestions(spark, d)
    rejected = found.where(F.col("original").like("%,BUILDIN%")).select("original")
    return correct.apply_corrections(_addresses(spark, d), found, rejected)


# part names: abbreviated words and their expansions come from the words of the table itself
_ABBREVIATIONS = "SELECT DISTINCT upper(left(w, 2)) AS token, first_value(w) OVER (PARTITION BY upper(left(w, 2)) ORDER BY w) AS replacement FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)"


def _shortened(spark, d) -> DataFrame:
    words = F.split("p_name", " ")
    short = F.concat_ws(" ", F.upper(F.left(F.element_at(words, 1), F.lit(2))), F.element_at(words, 2))
    return table(spark, d, "part").select("p_partkey", short.alias("name"))


def _abbreviations(spark, d) -> DataFrame:
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    return words.groupBy(F.upper(F.left("w", F.lit(2))).alias("Abbreviations")).agg(
        F.min("w").alias("Corrected_Abbreviations")
    )


@query(
    "expand_abbreviations",
    f"""
WITH a AS ({_ABBREVIATIONS}),
s AS (SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 2)) AS t1, split_part(p_name, ' ', 2) AS t2 FROM part)
SELECT p_partkey, coalesce(x.replacement, t1) || ' ' || coalesce(y.replacement, t2) AS name
FROM s LEFT JOIN a x ON x.token = t1 LEFT JOIN a y ON y.token = t2
""",
)
def expand_abbreviations(spark, d):
    return correct.expand_abbreviations(_shortened(spark, d), _abbreviations(spark, d), "name", "p_partkey")


# the vocabulary: cleaned words of the documents, with the number of documents using them
_WORDS = f"""
doc_words AS (SELECT doc_id, unnest(list_distinct(string_split({clean_sql('text')}, ' '))) AS word FROM documents),
vocabulary AS (SELECT word, count(*) AS frequency FROM doc_words WHERE word <> '' GROUP BY 1),
lines AS (SELECT item_id, {clean_sql('text')} AS text FROM benchmark),
tokens AS (SELECT DISTINCT w AS token FROM (SELECT unnest(string_split(text, ' ')) AS w FROM lines) WHERE length(w) > 3),
thirds AS (SELECT unnest([0, 1, 2]) AS i),
pieces AS (
  SELECT word, frequency, length(word) AS len, i, substr(word, i * (length(word) // 3) + 1, CASE i WHEN 2 THEN length(word) ELSE length(word) // 3 END) AS piece
  FROM vocabulary, thirds),
probes AS (
  SELECT DISTINCT token, len, i, substr(token, i * (len // 3) + d + 1, size) AS piece
  FROM (SELECT token, len, i, d, CASE i WHEN 2 THEN len - 2 * (len // 3) ELSE len // 3 END AS size
    FROM (SELECT token, length(token) + unnest([-2, -1, 0, 1, 2]) AS len FROM tokens WHERE token NOT IN (SELECT word FROM vocabulary)),
      thirds, (SELECT unnest([-2, -1, 0, 1, 2]) AS d))
  WHERE i * (len // 3) + d >= 0 AND i * (len // 3) + d + size <= length(token)),
candidates AS (
  SELECT DISTINCT token, word, levenshtein(token, word) AS edits, frequency
  FROM probes JOIN pieces USING (len, i, piece) WHERE levenshtein(token, word) <= 2),
fixes AS (
  SELECT token, word AS replacement FROM candidates
  QUALIFY row_number() OVER (PARTITION BY token ORDER BY edits, frequency DESC, word) = 1)
"""


def _vocabulary(spark, d) -> DataFrame:
    words = table(spark, d, "documents").select(
        F.explode(F.array_distinct(F.split(text.clean(F.col("text")), " "))).alias("word")
    )
    return words.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.clean(F.col("text")).alias("text"))


@query("word_candidates", f"WITH {_WORDS} SELECT token, word, CAST(edits AS INTEGER) AS edits, frequency FROM candidates")
def word_candidates(spark, d):
    return correct.word_candidates(_lines(spark, d), _vocabulary(spark, d), "text")


@query(
    "spell_correct",
    f"""
WITH {_WORDS},
t AS (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM lines)
SELECT item_id, ' ' || upper(string_agg(coalesce(replacement, w), ' ' ORDER BY i)) AS "Filtered_Name"
FROM t LEFT JOIN fixes ON token = w GROUP BY item_id
""",
)
def spell_correct(spark, d):
    fixed = correct.spell_correct(_lines(spark, d), _vocabulary(spark, d), "text", "item_id")
    return fixed.select("item_id", "Filtered_Name")


@query(
    "correction_ratio",
    f"WITH {_ADDRESSES} SELECT original, suggested, round(1 - edits / CAST(greatest(length(original), length(suggested)) AS DOUBLE), 6) AS ratio FROM suggestions",
)
def correction_ratio(spark, d):
    return _suggestions(spark, d).select(
        "original", "suggested", F.round(correct.correction_ratio("original", "suggested"), 6).alias("ratio")
    )


@query(
    "apply_provider_corrections",
    """
WITH s AS (SELECT DISTINCT p_name AS original, replace(p_name, 'widget', 'gadget') AS suggested FROM part WHERE p_name LIKE '%widget%')
SELECT p_partkey, CASE WHEN suggested IS NOT NULL AND original NOT LIKE 'red%' THEN suggested ELSE p_name END AS "Provider_Name"
FROM part LEFT JOIN s ON original = p_name
""",
)
def apply_provider_corrections(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("Provider_Name"))
    found = rows.where(F.col("Provider_Name").contains("widget")).select(
        F.col("Provider_Name").alias("original"),
        F.replace("Provider_Name", F.lit("widget"), F.lit("gadget")).alias("suggested"),
    ).distinct()
    rejected = found.where(F.col("original").startswith("red")).select("original")
    return correct.apply_provider_corrections(rows, found, rejected)


@query(
    "provider_near_duplicates",
    """
WITH ranks AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (SELECT DISTINCT s_name AS name FROM supplier)),
r AS (SELECT s_suppkey AS id, s_name AS name, pos FROM supplier JOIN ranks ON name = s_name)
SELECT a.id AS id_l, b.id AS id_r, a.name AS name_l, b.name AS name_r,
  round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 6) AS score
FROM r a JOIN r b ON a.id < b.id AND abs(a.pos - b.pos) <= 2
WHERE 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.8
""",
)
def provider_near_duplicates(spark, d):
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_name as name")
    found = correct.provider_near_duplicates(rows, "name", "id")
    return found.select("id_l", "id_r", "name_l", "name_r", F.round("score", 6).alias("score"))


@query(
    "provider_mean_score",
    """
WITH ranks AS (SELECT name, row_number() OVER (ORDER BY name) AS pos FROM (SELECT DISTINCT c_name AS name FROM customer)),
r AS (SELECT c_custkey AS id, c_name AS name, pos FROM customer JOIN ranks ON name = c_name)
SELECT count(*) AS pairs, round(avg(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE)), 6) AS mean_score
FROM r a JOIN r b ON a.id < b.id AND abs(a.pos - b.pos) <= 2
WHERE 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.8
""",
)
def provider_mean_score(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey as id", "c_name as name")
    found = correct.provider_near_duplicates(rows, "name", "id")
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))


# ---- tokens -------------------------------------------------------------------------------------


@query(
    "single_address",
    "SELECT p_partkey, p_name || ',' || p_brand || ',' || p_type || ',' || CAST(p_size AS VARCHAR) AS address FROM part",
)
def single_address(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", correct.single_address(["p_name", "p_brand", "p_type", "p_size"]).alias("address")
    )


_SPLIT = "list_filter(regexp_split_to_array({0}, '[ ,]'), lambda t: t <> '')"


@query("tokenize", f"SELECT doc_id, {_SPLIT.format('text')} AS tokens FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", text.tokenize(F.col("text")).alias("tokens"))


@query("word_tokens", "SELECT conv_id, turn, regexp_extract_all(text, '[A-Za-z0-9]+') AS words FROM conversations")
def word_tokens(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.word_tokens(F.col("text")).alias("words"))


@query(
    "strip_digit_tokens",
    f"SELECT doc_id, array_to_string(list_filter({_SPLIT.format('text')}, lambda t: NOT regexp_full_match(t, '[0-9]+')), ' ') AS stripped FROM documents",
)
def strip_digit_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.strip_digit_tokens(F.col("text")).alias("stripped"))


_DIGITS = "list_sort(list_filter(" + _SPLIT + ", lambda t: regexp_full_match(t, '[0-9]+')))"


@query(
    "same_digit_multiset",
    f"""
SELECT l.doc_id, CAST({_DIGITS.format('d.text')} = {_DIGITS.format('b.text')} AS INTEGER) AS same
FROM documents d JOIN labels l USING (doc_id) JOIN benchmark b ON b.item_id = d.doc_id
""",
)
def same_digit_multiset(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    items = table(spark, d, "benchmark").selectExpr("item_id as doc_id", "text as other")
    both = docs.join(items, "doc_id")
    return both.select(
        "doc_id", text.same_digit_multiset(F.col("text"), F.col("other")).cast("int").alias("same")
    )


@query(
    "jaccard",
    f"""
SELECT a.doc_id, round(len(list_intersect(x, y)) / CAST(len(list_distinct(list_concat(x, y))) AS DOUBLE), 6) AS jaccard
FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS doc_id, list_distinct({_SPLIT.format('text')}) AS x FROM conversations) a
JOIN (SELECT conv_id, turn, list_distinct({_SPLIT.format('text')}) AS y FROM conversations) b
ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn
""",
)
def jaccard(spark, d):
    """Each turn of a conversation against the next one."""
    turns = table(spark, d, "conversations")
    a = turns.select("conv_id", "turn", text.tokenize(F.col("text")).alias("x"))
    b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), text.tokenize(F.col("text")).alias("y"))
    return a.join(b, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"),
        F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"),
    )


# ---- vectors ------------------------------------------------------------------------------------

_COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    "cosine",
    f"SELECT a.vec_id, round({_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
)
def cosine(spark, d):
    rows = table(spark, d, "embeddings")
    a = rows.select("vec_id", F.col("embedding").alias("a"))
    b = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select(
        "vec_id", F.round(vectors.cosine(F.col("a"), F.col("b")), 6).alias("cosine")
    )


@query(
    "cosine_join",
    f"SELECT a.vec_id AS id_l, b.vec_id AS id_r, round({_COSINE}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND {_COSINE} >= 0.35",
)
def cosine_join(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = fuzzyjoin.cosine_join(rows, rows, "embedding", "id", 0.35, same=True)
    return found.withColumn("cosine", F.round("cosine", 6))


@query(
    "suggest_by_embedding",
    f"""
WITH best AS (
  SELECT a.vec_id, b.vec_id AS other, {_COSINE} AS c FROM embeddings a JOIN embeddings b ON a.label <> 0 AND b.label = 0
  WHERE {_COSINE} >= 0.3
  QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COSINE} DESC, b.vec_id) = 1)
SELECT e.vec_id AS id, round(c, 6) AS cosine, coalesce('v' || other, 'Nothing Found') AS suggested
FROM embeddings e LEFT JOIN best USING (vec_id) WHERE e.label <> 0
""",
)
def suggest_by_embedding(spark, d):
    """Label 0 is the reference list; the data's vectors are far apart, hence the low threshold."""
    rows = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vector"),
        F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("name"),
        "label",
    )
    found = correct.suggest_by_embedding(rows.where("label <> 0"), rows.where("label = 0"), 0.3)
    return found.select("id", F.round("cosine", 6).alias("cosine"), "suggested")


@query(
    "cluster_addresses",
    f"""
WITH RECURSIVE r AS (
  SELECT vec_id, embedding, {_DIGITS.format('text')} AS numbers FROM embeddings JOIN documents ON doc_id = vec_id),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM r a JOIN r b ON a.vec_id <> b.vec_id AND a.numbers = b.numbers AND {_COSINE} >= 0.42),
reach(x, y) AS (SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT r.vec_id, coalesce(min(reach.y) + 1, 0) AS group_id FROM r LEFT JOIN reach ON reach.x = r.vec_id GROUP BY r.vec_id
""",
)
def cluster_addresses(spark, d):
    rows = table(spark, d, "embeddings").join(
        table(spark, d, "documents").selectExpr("doc_id as vec_id", "text"), "vec_id"
    )
    found = correct.cluster_addresses(rows, "text", "embedding", "vec_id", 0.42)
    return found.select("vec_id", "group_id")


# ---- places -------------------------------------------------------------------------------------
#
# Suppliers stand in for the gazetteer and customers for the records; coordinates follow from keys.

_GEO = """
gazetteer AS (SELECT s_suppkey AS place_id, CAST((s_suppkey * 7919) % 17900 AS DOUBLE) / 100 - 89.5 AS latitude,
  CAST((s_suppkey * 104729) % 36000 AS DOUBLE) / 100 - 180 AS longitude, s_name AS display_name,
  CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) END AS state, 'P' || s_suppkey AS postcode FROM supplier),
people AS (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN CAST((c_custkey * 4001) % 17900 AS DOUBLE) / 100 - 89.5 END AS latitude,
  CAST((c_custkey * 50021) % 36000 AS DOUBLE) / 100 - 180 AS longitude, CAST(c_nationkey AS VARCHAR) AS state, 'C' || c_custkey AS zip FROM customer),
near AS (
  SELECT c_custkey, g.*, 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians(g.latitude - p.latitude) / 2), 2)
    + cos(radians(p.latitude)) * cos(radians(g.latitude)) * pow(sin(radians(g.longitude - p.longitude) / 2), 2)))) AS km
  FROM people p, gazetteer g WHERE p.latitude IS NOT NULL),
best AS (SELECT * FROM near WHERE km <= 800 QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY km, place_id) = 1)
"""


def _gazetteer(spark, d) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        key.alias("place_id"),
        ((key * 7919 % 17900).cast("double") / 100 - 89.5).alias("latitude"),
        ((key * 104729 % 36000).cast("double") / 100 - 180).alias("longitude"),
        F.col("s_name").alias("display_name"),
        F.when(key % 3 != 0, F.col("s_nationkey").cast("string")).alias("state"),
        F.concat(F.lit("P"), key.cast("string")).alias("postcode"),
    )


def _people(spark, d) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(
        "c_custkey",
        F.when(key % 13 != 0, (key * 4001 % 17900).cast("double") / 100 - 89.5).alias("latitude"),
        ((key * 50021 % 36000).cast("double") / 100 - 180).alias("longitude"),
        F.col("c_nationkey").cast("string").alias("state"),
        F.concat(F.lit("C"), key.cast("string")).alias("zip"),
    )


@query(
    "reverse_geocode_fix",
    f"WITH {_GEO} SELECT p.c_custkey, p.latitude, p.longitude, coalesce(b.state, p.state) AS state, coalesce(b.postcode, p.zip) AS zip FROM people p LEFT JOIN best b USING (c_custkey)",
)
def reverse_geocode_fix(spark, d):
    return geo.reverse_geocode_fix(
        _people(spark, d), _gazetteer(spark, d), {"state": "state", "zip": "postcode"}, 800.0
    )


@query(
    "attach_place_name",
    f"WITH {_GEO} SELECT p.c_custkey, b.display_name FROM people p LEFT JOIN best b USING (c_custkey)",
)
def attach_place_name(spark, d):
    return geo.attach_place_name(_people(spark, d), _gazetteer(spark, d), 800.0).select("c_custkey", "display_name")


@query(
    "geocode",
    f"WITH {_GEO} SELECT c_custkey, g.latitude, g.longitude FROM customer LEFT JOIN gazetteer g ON lower(replace(g.display_name, '#', '')) = lower(replace(replace(c_name, 'Customer', 'Supplier'), '#', ''))",
)
def geocode(spark, d):
    """Customers are looked up under the supplier name with their number."""
    rows = table(spark, d, "customer").select(
        "c_custkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("place")
    )
    return geo.geocode(rows, _gazetteer(spark, d), "place").select("c_custkey", "latitude", "longitude")


# ---- keyed encodings ----------------------------------------------------------------------------

_CLK = """
WITH t AS (
  SELECT c_custkey, list_distinct(list_transform(generate_series(1, length(' ' || c_name || ' ') - 1), lambda i: substr(' ' || c_name || ' ', CAST(i AS INTEGER), 2))) AS grams, 'c_name' AS f FROM customer
  UNION ALL
  SELECT c_custkey, list_distinct(list_transform(generate_series(1, length(CAST(c_nationkey AS VARCHAR))), lambda i: CAST(i AS VARCHAR) || ' ' || substr(CAST(c_nationkey AS VARCHAR), CAST(i AS INTEGER), 1))), 'c_nationkey' FROM customer),
k AS (SELECT c_custkey, unnest(list_transform(grams, lambda g: sha256('secret|' || f || '|' || g))) AS s, greatest(1, CAST(round(300 / CAST(len(grams) AS DOUBLE)) AS INTEGER)) AS n FROM t),
h AS (SELECT c_custkey, CAST('0x' || left(s, 7) AS BIGINT) AS h, CAST('0x' || substr(s, 8, 7) AS BIGINT) AS g, unnest(generate_series(1, n)) AS k FROM k)
SELECT c_custkey, list_sort(list_distinct(list(CAST((h + k * g) % 1024 AS INTEGER)))) AS clk FROM h GROUP BY c_custkey
"""


@query("clk_encode", _CLK)
def clk_encode(spark, d):
    fields = [privacy.ClkField("c_name"), privacy.ClkField("c_nationkey", "digits", sentinel="")]
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return privacy.clk_encode(rows, fields, "secret").select("c_custkey", "clk")
