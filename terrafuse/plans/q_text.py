"""Queries on names, addresses and codes."""

from pyspark.sql import functions as F

from terrafuse.functions import text as X
from terrafuse.operators import names as N
from terrafuse.plans.registry import PT, SPT, query
from terrafuse.sources import fixed_width, html, json_layers

#: Street types that the queries abbreviate; a register's own table is read from a file.
TYPES = {"AVENUE": "AV", "BOULEVARD": "BD", "CHEMIN": "CHE", "RUE": "R"}
_HEADS = ("Avenue de la ", "Boulevard du Général ", "Rue d'", "Chemin Saint ")


def _streets(t):
    """doc_id, name: a made-up street name of each document's words and number"""
    k = F.col("doc_id")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (k % 4 + 1).cast("int"))
    words = F.regexp_replace(F.col("text"), "[^\\p{L}]+", " ")
    return t.documents.select(k, F.concat(head, words, F.when(k % 3 == 0, " XIV").when(k % 3 == 1, F.concat(F.lit(" "), (k % 20).cast("string"))).otherwise("")).alias("name"))


_STREETS = """streets AS (SELECT doc_id, ['Avenue de la ', 'Boulevard du Général ', 'Rue d''', 'Chemin Saint '][doc_id % 4 + 1]
  || regexp_replace(text, '[^\\p{L}]+', ' ', 'g')
  || CASE doc_id % 3 WHEN 0 THEN ' XIV' WHEN 1 THEN ' ' || (doc_id % 20)::VARCHAR ELSE '' END AS name FROM documents)"""


def _nested(start: str, steps) -> str:
    for old, new in steps:
        start = f"replace({start}, '{old}', '{new}')"
    return start


_ASCII = "regexp_replace(strip_accents({}), '[^\\x00-\\x7F]', '', 'g')"
_TYPED = "CASE " + " ".join(f"WHEN a = '{k}' OR starts_with(a, '{k} ') THEN '{v}' || substr(a, {len(k) + 1})" for k, v in TYPES.items()) + " ELSE a END"
_STEPS = [(" EME ", "EME "), *((str(d), w) for d, w in enumerate(X.DIGITS)), *((f" {a} ", f" {b} ") for a, b in X.NUMBER_WORDS.items()),
          *((f" {w} ", " ") for w in X.ARTICLES), *((f" {a} ", f" {b} ") for a, b in X.TITLES.items())]
_ROMAN = "CASE r " + " ".join(f"WHEN '{X.roman(n)}' THEN '{X.digit_words(n)}'" for n in range(1, 24)) + " END"


@query(
    f"""WITH {_STREETS},
a AS (SELECT doc_id, name, regexp_replace(translate(upper({_ASCII.format("name")}), '-''/', '   '), ' +', ' ', 'g') AS a FROM streets),
b AS (SELECT doc_id, name, {_nested(f"({_TYPED})", _STEPS)} AS b FROM a),
c AS (SELECT *, regexp_extract(b, ' ([IVX]+)$', 1) AS r FROM b)
SELECT doc_id, name, CASE WHEN {_ROMAN} IS NOT NULL THEN substr(b, 1, length(b) - length(r)) || {_ROMAN} ELSE b END AS normal FROM c"""
)
def street_normalize(t):
    return _streets(t).withColumn("normal", X.normalize_street(F.col("name"), TYPES))


@query(
    f"""WITH {_STREETS}, n AS (SELECT doc_id, trim(regexp_replace(regexp_replace(translate({_ASCII.format("lower(name)")}, '-_''', '   '), '\\bsainte?\\b', 'st', 'g'), ' +', ' ', 'g')) AS web FROM streets)
SELECT * FROM n WHERE regexp_matches(web, '\\b0?st ')"""
)
def web_normalize_filter(t):
    return _streets(t).select("doc_id", X.web_normalize(F.col("name")).alias("web")).where(F.col("web").rlike(r"\b0?st "))


_SMALL = ", ".join(f"'{w}'" for w in X.SMALL_WORDS)


@query(
    f"""WITH p AS (SELECT p_partkey, string_split(lower(['chemin de la ', 'rue du ', 'place des '][p_partkey % 3 + 1] || p_name), ' ') AS w FROM part)
SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN i > 1 AND x IN ({_SMALL}) THEN x ELSE upper(x[1]) || x[2:] END), ' ') AS title FROM p"""
)
def humanise_title(t):
    head = F.element_at(F.array(F.lit("chemin de la "), F.lit("rue du "), F.lit("place des ")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", X.humanise_title(F.concat(head, "p_name")).alias("title"))


_ADDRESS = "p_size::VARCHAR || [' bis', 'B', 'T', ' ter', ''][p_partkey % 5 + 1] || ' ' || p_name"
_NUMBER = "'(?i)^([0-9]+)((?: bis)|(?: ter)|(?: quater)|(?: quinquies)|(?:[A-Za-z?]*))\\b'"


def _addresses(t):
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" bis", "B", "T", " ter", "")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return t.part.select("p_partkey", "p_brand", F.concat(F.col("p_size").cast("string"), suffix, F.lit(" "), "p_name").alias("address"))


@query(
    f"""WITH a AS (SELECT p_partkey, {_ADDRESS} AS address FROM part),
n AS (SELECT *, regexp_extract(address, {_NUMBER}, 1) AS number, regexp_extract(address, {_NUMBER}, 2) AS suffix FROM a)
SELECT p_partkey, number, trim(suffix) AS suffix, trim(substr(address, length(number) + length(suffix) + 1)) AS street FROM n"""
)
def house_number_split(t):
    number, suffix, street = X.house_number(F.col("address"))
    return _addresses(t).select("p_partkey", number.alias("number"), suffix.alias("suffix"), street.alias("street"))


@query(
    """WITH a AS (SELECT p_partkey, p_brand AS street, p_size AS number, ['B', 'T', 'Q', 'b', CASE WHEN p_partkey % 7 = 0 THEN 'A' ELSE 'T' END][p_partkey % 5 + 1] AS letter FROM part),
w AS (SELECT *, bool_and(upper(letter) IN ('B', 'T', 'Q')) OVER (PARTITION BY street, number) AS known FROM a)
SELECT p_partkey, street, number, letter, CASE WHEN known THEN CASE upper(letter) WHEN 'B' THEN 'bis' WHEN 'T' THEN 'ter' ELSE 'quater' END ELSE letter END AS series FROM w"""
)
def bis_ter_series(t):
    k = F.col("p_partkey")
    letter = F.element_at(F.array(F.lit("B"), F.lit("T"), F.lit("Q"), F.lit("b"), F.when(k % 7 == 0, "A").otherwise("T")), (k % 5 + 1).cast("int"))
    return N.letter_series(t.part.select(k, F.col("p_brand").alias("street"), F.col("p_size").alias("number"), letter.alias("letter")))


@query("SELECT p_partkey, CAST(unnest(generate_series(p_size, p_size + p_partkey % 8, 2)) AS INTEGER) AS number FROM part")
def number_interval_expand(t):
    text = F.concat(F.col("p_size").cast("string"), F.lit(" à "), (F.col("p_size") + F.col("p_partkey") % 8).cast("string"), F.lit(" RUE X"))
    return t.part.select("p_partkey", F.explode(X.interval_numbers(text)).alias("number"))


@query(
    """WITH a AS (SELECT p_partkey, p_size::VARCHAR || ' RUE ' || p_name || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'BAT A' || chr(10) ELSE '' END
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE lpad((p_partkey % 95000)::VARCHAR, 5, '0') || ' VILLE' END AS address FROM part)
SELECT p_partkey, trim(replace(regexp_replace(address, '(?s)^(.*)(^|\n)[0-9]{5}.*$', '\\1'), chr(10), ' ')) AS street FROM a"""
)
def postal_truncate(t):
    k = F.col("p_partkey")
    code = F.concat(F.lpad((k % 95000).cast("string"), 5, "0"), F.lit(" VILLE"))
    address = F.concat(F.col("p_size").cast("string"), F.lit(" RUE "), "p_name", F.lit("\n"), F.when(k % 3 == 0, "BAT A\n").otherwise(""), F.when(k % 4 == 0, "").otherwise(code))
    return t.part.select(k, X.postal_truncate(address).alias("street"))


_FUZZY = """n AS (SELECT DISTINCT p_brand, p_size, p_name AS name FROM part),
p AS (SELECT a.p_brand, a.p_size, a.name AS text, b.name FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.name <> b.name),
w AS (SELECT *, string_split(name, ' ') AS a, string_split(text, ' ') AS b FROM p),
-- all names have two words: the last takes the nearer one (ties: the one that sorts first), the first the other
d AS (SELECT *, levenshtein(a[1], b[1]) AS d11, levenshtein(a[1], b[2]) AS d12, levenshtein(a[2], b[1]) AS d21, levenshtein(a[2], b[2]) AS d22 FROM w),
s AS (SELECT *, CAST(CASE WHEN d21 < d22 OR (d21 = d22 AND b[1] <= b[2]) THEN d21 + d12 ELSE d22 + d11 END AS INTEGER) AS distance FROM d)"""


@query(f"WITH {_FUZZY}, b AS (SELECT p_brand, p_size, text, min({{'d': distance, 'c': name}}) AS m FROM s GROUP BY ALL) SELECT p_brand, p_size, text, m.c AS name, m.d AS distance FROM b WHERE m.d < 0.5 * length(m.c)")
def fuzzy_name_match(t):
    """Each name against the others of its brand and size."""
    names = t.part.select("p_brand", "p_size", F.col("p_name").alias("name")).distinct()
    pairs = names.withColumnRenamed("name", "text").join(names, ["p_brand", "p_size"]).where("name <> text")
    return N.best_names(pairs, ["p_brand", "p_size", "text"])


@query(
    f"""WITH {PT}, {SPT}, d AS (SELECT pt.id, spt.id AS site, sqrt((pt.x - spt.x) * (pt.x - spt.x) + (pt.y - spt.y) * (pt.y - spt.y)) AS d FROM pt, spt),
m AS (SELECT id, min({{'d': d, 's': site}}) AS m FROM d GROUP BY id) SELECT id, 'S' || m.s AS text, round(m.d, 6) AS away FROM m WHERE m.d <= 3"""
)
def street_within_reach(t):
    drawn = t.spt.withColumn("text", F.concat(F.lit("S"), F.col("id").cast("string")))
    return N.streets_within(t.pt, drawn, 3.0).select("id", "text", F.round("away", 6).alias("away"))


@query(
    """WITH d AS (SELECT 'bolt' AS a, 'Bôlt' AS b UNION ALL SELECT 'blue', 'Bleu' UNION ALL SELECT 'ring', 'Rîng')
SELECT p_partkey AS id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'bolt' THEN 'Bôlt' WHEN 'blue' THEN 'Bleu' WHEN 'ring' THEN 'Rîng' ELSE w END), ' ') AS told FROM part"""
)
def dictionary_applied(t):
    words = t.spark.createDataFrame([("bolt", "Bôlt"), ("blue", "Bleu"), ("ring", "Rîng")], "ascii string, word string")
    return N.with_dictionary(F.col("name"), words, t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), "told").select("id", "told")


@query(
    """WITH r AS (SELECT upper(p_name) || ' ' || (p_size % 40)::VARCHAR AS name, min(p_partkey) AS code FROM part WHERE p_size > 0 GROUP BY 1 HAVING count(DISTINCT p_partkey) = 1)
SELECT p_partkey, name, code FROM part JOIN r ON upper(p_name) || ' ' || (p_size % 40)::VARCHAR = name"""
)
def register_lookup_conflict(t):
    name = F.concat(F.upper("p_name"), F.lit(" "), (F.col("p_size") % 40).cast("string"))
    parts = t.part.withColumn("name", name)
    return parts.join(N.unambiguous(parts.select("name", F.col("p_partkey").alias("code")), "name", "code"), "name").select("p_partkey", "name", "code")


@query(
    """WITH g AS (SELECT p_name, list(p_partkey ORDER BY p_partkey) AS ids FROM part GROUP BY p_name)
SELECT p_name, CAST(len(ids) AS INTEGER) AS n, ids[1] AS first_id, ids[-1] AS last_id, array_to_string(ids, ',') AS ids FROM g"""
)
def names_to_ids(t):
    return N.ids_by_name(t.part, "p_name", "p_partkey")


@query(
    f"""WITH w AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(lower(regexp_replace(text, '[^\\p{{L}}]+', ' ', 'g')), ' ')) AS word FROM documents)),
a AS (SELECT word, {_ASCII.format("word")} AS ascii FROM w WHERE word <> '')
SELECT ascii, min(word) AS word FROM a WHERE ascii <> '' AND ascii <> word GROUP BY ascii HAVING count(DISTINCT word) = 1"""
)
def accent_dictionary(t):
    words = F.explode(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}]+", " ")), " "))
    return N.accent_dictionary(t.documents.select(words.alias("word")).distinct())


@query("SELECT p_type, arg_min(p_name, {'n': length(p_name), 'x': p_name}) AS p_name FROM part GROUP BY p_type")
def abbrev_shortest(t):
    return N.shortest_names(t.part, "p_type", "p_name")


@query(
    """WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey = 24 THEN '971' ELSE lpad((c_nationkey + 1)::VARCHAR, 3, '0') END AS dep, 'AB' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS commune FROM customer)
SELECT c_custkey, dep, commune, CASE WHEN dep[1] = '0' THEN substr(dep, 2, 2) ELSE substr(dep, 1, 2) END || substr(commune, 3, 3) AS insee FROM c"""
)
def insee_code(t):
    dep = F.when(F.col("c_nationkey") == 24, "971").otherwise(F.lpad((F.col("c_nationkey") + 1).cast("string"), 3, "0"))
    rows = t.customer.select("c_custkey", dep.alias("dep"), F.concat(F.lit("AB"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0")).alias("commune"))
    return rows.withColumn("insee", X.insee_code(F.col("dep"), F.col("commune")))


@query("SELECT c_custkey, replace(replace(replace(c_name || ' & <' || c_mktsegment || '>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped, c_name || ' & <' || c_mktsegment || '>' AS plain FROM customer")
def xml_escape_roundtrip(t):
    plain = F.concat("c_name", F.lit(" & <"), "c_mktsegment", F.lit(">"))
    return t.customer.select("c_custkey", X.xml_escape(plain).alias("escaped"), X.html_unescape(X.xml_escape(plain)).alias("plain"))


@query(
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, lpad((l_orderkey % 99 + 1)::VARCHAR, 2, '0') || lpad((l_partkey % 1000)::VARCHAR, 3, '0') AS insee,
  lpad((l_suppkey % 10000)::VARCHAR, 4, '0') AS code, CASE WHEN l_returnflag = 'R' THEN true ELSE false END AS cancelled,
  CASE l_linenumber WHEN 1 THEN true WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS is_street FROM lineitem"""
)
def fixed_width_parse(t):
    k = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
    line = F.concat(
        F.lpad((F.col("l_orderkey") % 99 + 1).cast("string"), 2, "0"), F.lit("0"), F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"),
        F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0"), F.lit("K"), F.rpad(F.lit("RUE"), 4, " "), F.rpad(F.lit("DU PORT"), 26, " "),
        F.lit(" " * 32), F.when(F.col("l_returnflag") == "R", "A").otherwise(" "), F.lit(" " * 34), F.col("l_linenumber").cast("string"),
    )
    rows = fixed_width.parse_register(t.lineitem.select(*k, line.alias("value")))
    return rows.select(*k, "insee", "code", "cancelled", "is_street")


@query(
    """SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS INTEGER) AS links,
  array_to_string(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), ' ') AS hrefs FROM pages"""
)
def html_options(t):
    return html.titles_and_links(t.pages)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type || ':' || json_extract_string(props, '$.k') AS label FROM events")
def json_props(t):
    return json_layers.properties(t.events, "props", "k int").select("event_id", "k", F.concat_ws(":", "event_type", F.col("k").cast("string")).alias("label"))


@query("SELECT p_partkey, concat_ws('|', nullif(trim(p_type), ''), nullif(trim(p_brand), ''), nullif(trim(p_name), ''), p_size::VARCHAR) AS tex FROM part")
def tex_order(t):
    props = F.create_map(F.lit("TEX10"), F.col("p_size").cast("string"), F.lit("TEX2"), F.concat("p_name", F.lit(" ")), F.lit("TEX"), F.col("p_type"), F.lit("TEX1"), F.col("p_brand"), F.lit("SYM"), F.lit("x"))
    return t.part.select("p_partkey", F.array_join(json_layers.tex_values(props), "|").alias("tex"))
