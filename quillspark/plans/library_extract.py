"""Extraction, resolution, notation and block rules, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import notation as N
from quillspark.functions import terms as X
from quillspark.functions import text as T
from quillspark.operators import matching
from quillspark.plans.library import _quoted, query
from quillspark.session import stored, table

# ---------------------------------------------------------------- terms

PHRASE = r"[A-Z][A-Za-z'-]*(?: [A-Za-z'-]+){0,2}"


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct candidate terms: phrases that begin with a capital in the documents, names and aliases of concepts."""
    d = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(PHRASE), F.lit(0))).alias("term"))
    c = table(spark, sf_dir, "concepts").select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    return d.unionByName(c).filter("term IS NOT NULL").distinct()


TERMS = f"""t AS (SELECT unnest(regexp_extract_all(text, '{PHRASE.replace("'", "''")}')) AS term FROM documents UNION SELECT canonical_name FROM concepts UNION SELECT unnest(aliases) FROM concepts), tt AS (SELECT DISTINCT term FROM t WHERE term IS NOT NULL)"""
_W = "list_filter(string_split_regex({x}, '\\s+'), lambda z: z <> '')"
_IN = lambda x, words: f"{x} IN ({_quoted(words)})"
_TRIMMED = f"""(SELECT term, w, coalesce(list_min(list_filter(generate_series(1, len(w)), lambda i: NOT lower(w[i]) IN ({_quoted(X.LEADING)}))), len(w) + 1) AS f FROM (SELECT term, {_W.format(x='term')} AS w FROM tt) z)"""


@query(f"""WITH {TERMS}, a AS (SELECT term, w[f:] AS w FROM {_TRIMMED} y), b AS (SELECT term, w, coalesce(list_max(list_filter(generate_series(1, len(w)), lambda i: NOT lower(w[i]) IN ({_quoted(X.TRAILING)}))), 0) AS e FROM a)
SELECT term, array_to_string(w[1:e], ' ') AS trimmed FROM b""")
def prj_28_trimmed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).select("term", X.trimmed(F.col("term")).alias("trimmed"))


_CLEAN = "regexp_replace(trim(term), '[:;,.!?]+$', '')"
_STRIP = """regexp_replace(z, '^[.,;:!?()\\[\\]{}"'']+|[.,;:!?()\\[\\]{}"'']+$', '', 'g')"""


@query(f"""WITH {TERMS}, a AS (SELECT term, {_CLEAN} AS clean, lower({_CLEAN}) AS low FROM tt), b AS (SELECT *, list_transform({_W.format(x='low')}, lambda z: {_STRIP}) AS w FROM a)
SELECT term, length(clean) < 3 OR {_IN('low', X.FILLERS)} OR {_IN('low', X.SINGLE)} OR {_IN('low', X.ACTIONS)} OR (low LIKE '%ly' AND length(low) > 4 AND NOT contains(low, ' ')) OR len(w) = 0
 OR (len(w) = 1 AND ({_IN('w[1]', X.SINGLE + ['with', 'many', 'few', 'some', 'any', 'every'])})) OR {_IN('w[1]', X.ACTIONS + X.LEADING)} OR {_IN('w[len(w)]', X.ACTIONS + X.TRAILING + ['upon', 'with', 'using'])}
 OR len(list_filter(w, lambda z: {_IN('z', X.CLAUSE)})) > 0 OR len(list_filter(w[2:len(w) - 1], lambda z: {_IN('z', X.INSIDE)})) > 0 OR trim(term) LIKE '%:' OR regexp_matches(term, '[{{}}\\[\\]]') AS fragment,
 len(list_filter({_W.format(x='term')}, lambda z: NOT {_IN('lower(z)', X.LEADING)})) > 0 AND len(list_filter({_W.format(x='term')}, lambda z: NOT {_IN('lower(z)', X.LEADING)} AND NOT {_IN('lower(z)', X.DISCOURSE)})) = 0 AS discourse FROM b""")
def prj_21_22_term_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms that are fragments of sentences, or connectives only."""
    t = F.col("term")
    return terms(spark, sf_dir).select("term", X.is_fragment(t).alias("fragment"), X.is_discourse(t).alias("discourse"))


@query(r"""WITH d AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '\b([A-Z][a-z]{2,}),\s+[A-Z]\.', 1) || flatten(list_transform(regexp_extract_all(text, '(?s)(.{0,80})\(\s*[A-Z0-9]{6,}\s*\)', 1), lambda s: list_filter(regexp_extract_all(s, '[A-Z][A-Za-z'']+'), lambda z: NOT lower(z) IN (""" + _quoted(X.STOP_TERMS) + r""")))), lambda z: lower(z))) AS keys FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_sort(keys), ',') AS person_keys FROM d""")
def prj_27_person_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.array_join(X.person_keys(F.col("text")), ",").alias("person_keys"))


_SURFACE = "array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(translate(lower(trim({x})), '’`', ''''''), '''s\\b', '', 'g'), '[^\\p{{L}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+'), lambda w: w <> ''), lambda w: CASE w " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in X.SURFACE_NUMERALS.items()) + " ELSE w END), ' ')"
_EQUIV = "CASE " + " ".join(f"WHEN k IN ({_quoted(sorted({X.py_surface_key(p) for p in ps}))}) THEN '{name.replace(chr(39), chr(39) * 2)}'" for name, ps in X.EQUIVALENT.items()) + " END"
#: Names of the registry beside the collection's own.
_REGISTRY = sorted({p for ps in X.EQUIVALENT.values() for p in ps} | {n for ns in X.NEAR_MISSES for n in ns} | {"Newton’s Second Law", "Speed", "tensor"})


def all_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "concepts").select(F.explode(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("term"))
    return c.unionByName(spark.createDataFrame([(n,) for n in _REGISTRY], "term string")).filter("term IS NOT NULL").distinct()


_ALL_NAMES = "n AS (SELECT canonical_name AS term FROM concepts UNION SELECT unnest(aliases) FROM concepts UNION SELECT unnest([" + _quoted(_REGISTRY) + "])), nn AS (SELECT DISTINCT term, " + _SURFACE.format(x="term") + " AS k FROM n WHERE term IS NOT NULL)"
_NEAR = " OR ".join("((" + " OR ".join(f"contains(a.k, '{X.py_surface_key(n)}')" for n in ns) + ") AND (" + " OR ".join(f"contains(b.k, '{X.py_surface_key(n)}')" for n in ns) + "))" for ns in X.NEAR_MISSES)


@query(f"WITH {_ALL_NAMES} SELECT term, k AS surface_key, {_EQUIV} AS equivalent FROM nn")
def qc_03_equivalents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name's key as written, and the registered name of the same meaning."""
    return all_names(spark, sf_dir).select("term", X.surface_key(F.col("term")).alias("surface_key"), X.equivalent(F.col("term")).alias("equivalent"))


@query(f"WITH {_ALL_NAMES}, p AS (SELECT a.term AS term_a, b.term AS term_b, a.k = b.k AS same, ({_NEAR}) AND a.k <> b.k AS near_miss FROM nn a JOIN nn b ON a.term < b.term WHERE a.k = b.k OR ({_NEAR})) SELECT term_a, term_b, near_miss, same AND NOT near_miss AS variants FROM p")
def qc_02_str_23_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of names that are variants of one, or must never be merged; they meet on their keys and on the sets that veto them."""
    n = all_names(spark, sf_dir).withColumn("k", X.surface_key(F.col("term")))
    sets = F.array_compact(F.array(*[F.when(F.greatest(*[F.contains("k", F.lit(X.py_surface_key(x))) for x in ns]), F.lit(f"set {i}")) for i, ns in enumerate(X.NEAR_MISSES)]))
    keyed = n.withColumn("bucket", F.explode(F.array_append(sets, F.concat(F.lit("key "), F.col("k")))))
    a, b = (keyed.select("bucket", F.col("term").alias(f"term_{x}")) for x in "ab")
    p = a.join(b, "bucket").filter("term_a < term_b").select("term_a", "term_b").distinct()
    return p.select("term_a", "term_b", X.is_near_miss(F.col("term_a"), F.col("term_b")).alias("near_miss"), X.are_variants(F.col("term_a"), F.col("term_b")).alias("variants"))


_DEFINES = r"([A-Za-z0-9 '-]{2,40}) (?:is defined as|refers to|is called|is known as|can be defined as|is described as|means|describes) ([^.\n]+)"
_COLON = r"(?:^|\n)\s*([A-Za-z0-9 '-]{2,35}):\s+([A-Z][^\n]{10,})"
_ACRONYM = r"([A-Z][A-Za-z0-9 '-]{2,40})\s*\(([A-Z]{2,6})\)"
_FORMULA = r"[A-Za-z_]+\s*=\s*[A-Za-z0-9 +*/^()-]+"


@query(rf"""WITH e AS (SELECT DISTINCT document_id, evidence_id, excerpt AS t FROM evidence WHERE excerpt IS NOT NULL UNION SELECT 'questions', question_id, explanation FROM questions WHERE explanation IS NOT NULL),
h AS (SELECT document_id, evidence_id, 'definition' AS kind, unnest(regexp_extract_all(t, '{_DEFINES.replace("'", "''")}', 1)) AS term FROM e UNION ALL SELECT document_id, evidence_id, 'colon', unnest(regexp_extract_all(t, '{_COLON.replace("'", "''")}', 1)) FROM e
 UNION ALL SELECT document_id, evidence_id, 'acronym', unnest(regexp_extract_all(t, '{_ACRONYM.replace("'", "''")}', 2)) FROM e UNION ALL SELECT document_id, evidence_id, 'formula', unnest(regexp_extract_all(t, '{_FORMULA}')) FROM e)
SELECT document_id, kind, lower(trim(term)) AS term, count(*) AS times FROM h GROUP BY 1, 2, 3""")
def str_14_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that texts define, by sentence, colon or acronym, and their formulas."""
    e = table(spark, sf_dir, "evidence").select("document_id", "evidence_id", F.col("excerpt").alias("t")).unionByName(table(spark, sf_dir, "questions").select(F.lit("questions").alias("document_id"), F.col("question_id").alias("evidence_id"), F.col("explanation").alias("t"))).filter("t IS NOT NULL").distinct()
    kinds = {"definition": (_DEFINES, 1), "colon": (_COLON, 1), "acronym": (_ACRONYM, 2), "formula": (_FORMULA, 0)}
    named = lambda k: lambda x: F.struct(F.lit(k).alias("kind"), F.lower(F.trim(x)).alias("term"))
    all_ = F.concat(*[F.transform(F.regexp_extract_all("t", F.lit(p), F.lit(g)), named(k)) for k, (p, g) in kinds.items()])
    return e.select("document_id", F.explode(all_).alias("h")).groupBy("document_id", "h.kind", "h.term").agg(F.count("*").alias("times"))


_DEF_TERMS = rf"""h AS (SELECT DISTINCT lower(trim(term)) AS term FROM (SELECT unnest(regexp_extract_all(excerpt, '{_DEFINES.replace("'", "''")}', 1)) AS term FROM evidence UNION SELECT unnest(aliases) FROM concepts) z WHERE length(trim(term)) >= 3), nm AS (SELECT DISTINCT concept_id, lower(trim(canonical_name)) AS name FROM concepts WHERE length(trim(canonical_name)) >= 3)"""


@query(f"""WITH {_DEF_TERMS}, p AS (SELECT h.term, nm.concept_id, nm.name, h.term = nm.name AS exact FROM h JOIN nm ON contains(h.term, nm.name) OR contains(nm.name, h.term))
SELECT term, arg_min(concept_id, (NOT exact, concept_id, name)) AS concept_id, bool_or(exact) AS exact FROM p GROUP BY 1""")
def jn_07_27_definition_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept each defined term or alias means: the same name, or one that is a part of the other."""
    e = table(spark, sf_dir, "evidence").select(F.explode(F.regexp_extract_all("excerpt", F.lit(_DEFINES), F.lit(1))).alias("term"))
    c = table(spark, sf_dir, "concepts")
    t = e.unionByName(c.select(F.explode("aliases").alias("term")))
    return matching.best_names(t, c.select(F.col("concept_id").alias("name_id"), F.col("canonical_name").alias("name"))).select("term", F.col("name_id").alias("concept_id"), "exact")


@query("""WITH i AS (SELECT DISTINCT interaction_id, question_id, response, unnest(list_distinct(concept_ids)) AS concept_id FROM interactions WHERE correctness < 0.5 AND response IS NOT NULL AND question_id IS NOT NULL)
SELECT 'misc_' || concept_id || '_' || substr(sha256(concept_id || ':' || array_to_string(list_filter(string_split_regex(lower(question_id || ' ' || response), '\\s+'), lambda w: w <> ''), ' ')), 1, 10) AS misconception_id, count(*) AS frequency, least(0.98, 0.4 + 0.25 * (count(*) - 1))::DOUBLE AS confidence, CASE WHEN count(*) >= 2 THEN 'SUPPORTED' ELSE 'SUSPECTED' END AS status FROM i GROUP BY 1""")
def str_12_prj_43_misconception_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong responses as signs of misconceptions, over all learners, by a key that holds across sessions."""
    i = table(spark, sf_dir, "interactions").filter("correctness < 0.5 AND response IS NOT NULL AND question_id IS NOT NULL").select("interaction_id", "question_id", "response", F.explode(F.array_distinct("concept_ids")).alias("concept_id")).distinct()
    k = X.misconception_key(F.col("concept_id"), F.concat_ws(" ", "question_id", "response"))
    n = F.col("frequency")
    return i.groupBy(k.alias("misconception_id")).agg(F.count("*").alias("frequency")).select("misconception_id", "frequency", F.least(F.lit(0.98), 0.4 + 0.25 * (n - 1)).alias("confidence"), F.when(n >= 2, "SUPPORTED").otherwise("SUSPECTED").alias("status"))


# ---------------------------------------------------------------- notation and resources

#: Written forms of laws beside the collection's own formulas.
_FORMULAS = ["F = m a", "F_net = m * a", "v = u + at", "v = v_0 + a t", "Y = C + I + G + NX", "GDP = C + I + G + (X - M)", "s = u t", "x = v0 t", "T(n) = 2T(n/2) + O(n)", "E = m c^2"]


def formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = table(spark, sf_dir, "questions").select(F.explode(F.regexp_extract_all("explanation", F.lit(_FORMULA), F.lit(0))).alias("formula"))
    return q.select(F.trim("formula").alias("formula")).unionByName(spark.createDataFrame([(x,) for x in _FORMULAS], "formula string")).distinct()


_ANY = {}
for _table in N.SYMBOLS.values():
    for _k, _v in (_table | {k.replace(" ", ""): v for k, v in _table.items()}).items():
        _ANY.setdefault(_k, _v)
_MEAN = "CASE {x} " + " ".join("WHEN '" + k.replace("'", "''") + "' THEN '" + v + "'" for k, v in _ANY.items()) + " ELSE lower({x}) END"
def _mean(x: str) -> str:
    return _MEAN.replace("{x}", x)


_VARS = r"list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(regexp_replace(formula, '[0-9+\-*/=()^,;\[\]{}]', ' ', 'g'), '\\(?:frac|sqrt|sin|cos|tan|log|ln|lim|sum|int|Theta|Delta)', ' ', 'g'), '\s+'), lambda t: t <> '')))"
_LAW = "CASE " + " ".join("WHEN regexp_matches(trim(formula), '(?i)" + p.replace("'", "''") + f"') THEN '{name}'" for name, p in N.LAWS.items()) + " END"
_FORMS = rf"f AS (SELECT DISTINCT trim(formula) AS formula FROM (SELECT unnest(regexp_extract_all(explanation, '{_FORMULA}')) AS formula FROM questions UNION SELECT unnest([{_quoted(_FORMULAS)}])) z), fv AS (SELECT formula, {_VARS} AS v, {_LAW} AS law FROM f), fm AS (SELECT *, list_distinct(list_transform(v, lambda s: {_mean('s')})) AS m FROM fv)"


@query(f"WITH {_FORMS} SELECT formula, array_to_string(v, ',') AS variables, array_to_string(list_sort(m), ',') AS meanings, law FROM fm")
def str_16_17_18_formula_meanings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("formula")
    return formulas(spark, sf_dir).select("formula", F.array_join(N.variables(c), ",").alias("variables"), F.array_join(F.array_sort(N.meanings(c)), ",").alias("meanings"), N.law(c).alias("law"))


@query(f"""WITH {_FORMS}, x AS (SELECT a.formula, b.formula AS other, CASE WHEN lower(a.formula) = lower(b.formula) THEN 1.0 WHEN a.law = b.law THEN 0.95 WHEN len(a.m) > 0 AND len(b.m) > 0 AND len(list_intersect(a.m, b.m)) / len(list_distinct(a.m || b.m)) >= 0.7 THEN round(0.7 + 0.25 * len(list_intersect(a.m, b.m)) / len(list_distinct(a.m || b.m)), 2) ELSE 0.1 END::DOUBLE AS score
FROM fm a JOIN fm b ON a.formula <> b.formula AND (a.law = b.law OR len(list_intersect(a.m, b.m)) > 0))
SELECT formula, arg_min(other, (-score, other)) AS best, max(score) AS score FROM x GROUP BY 1""")
def jn_21_set_09_formula_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula most like each one in what its symbols mean; formulas meet on laws and meanings they share."""
    c = F.col("formula")
    f = stored(formulas(spark, sf_dir).withColumn("meet", F.array_union(N.meanings(c), F.array_compact(F.array(F.concat(F.lit("law "), N.law(c)))))))
    k = f.select("formula", F.explode("meet").alias("k"))
    p = k.join(k.withColumnRenamed("formula", "other"), "k").filter("formula != other").select("formula", "other").distinct()
    s = p.withColumn("score", N.equivalence(F.col("formula"), F.col("other")))
    return s.groupBy("formula").agg(F.min_by("other", F.struct(-F.col("score"), F.col("other"))).alias("best"), F.max("score").alias("score"))


_DIFF = f"list_transform(list_filter(flatten(list_transform(a.v, lambda p: list_transform(b.v, lambda q: [p, q]))), lambda z: {_mean('z[1]')} = {_mean('z[2]')} AND z[1] <> z[2]), lambda z: z[2] || ' for ' || replace({_mean('z[1]')}, '_', ' ') || ' (' || z[1] || ')')"


@query(f"WITH {_FORMS} SELECT a.formula, b.formula AS other, array_to_string(({_DIFF})[1:2], ', ') AS differences FROM fm a JOIN fm b ON a.law = b.law AND a.formula <> b.formula")
def str_22_symbol_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How formulas of one law write their symbols."""
    f = formulas(spark, sf_dir).withColumn("law", N.law(F.col("formula"))).filter("law IS NOT NULL")
    p = f.join(f.withColumnRenamed("formula", "other"), "law").filter("formula != other")
    return p.select("formula", "other", N.differences(F.col("formula"), F.col("other")).alias("differences"))


_RES = """rs AS (SELECT doc_id AS resource_id, document_id, concept_ids, lower(coalesce(text, '')) AS low, (coalesce(n_chars, 0) % 100) / 100.0::DOUBLE AS difficulty, lang IS NOT NULL AS transcript, CASE WHEN source IS NULL THEN 0.5 ELSE 0.9 END::DOUBLE AS confidence FROM documents),
pq AS (SELECT DISTINCT target_concept_id AS concept_id, source_concept_id AS p FROM prerequisite_links), rc AS (SELECT rs.*, unnest(list_distinct(concept_ids)) AS concept_id FROM rs),
rp AS (SELECT rc.resource_id, rc.concept_id, count(pq.p) AS n FROM rc LEFT JOIN pq ON pq.concept_id = rc.concept_id AND list_contains(rc.concept_ids, pq.p) GROUP BY 1, 2),
sc AS (SELECT rc.resource_id, rc.concept_id, round(0.35::DOUBLE * CASE WHEN length(trim(c.canonical_name)) > 0 AND contains(rc.low, lower(trim(c.canonical_name))) THEN 0.95::DOUBLE ELSE 0.7::DOUBLE END + 0.3::DOUBLE * 0.75::DOUBLE + 0.15::DOUBLE * CASE WHEN rp.n > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + 0.25::DOUBLE * rp.n) ELSE 0.5::DOUBLE END
 + 0.1::DOUBLE * CASE WHEN difficulty <= 0.55 THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END + 0.1::DOUBLE * rc.confidence * CASE WHEN transcript THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END + 1e-9, 3) AS score FROM rc JOIN concepts c ON c.concept_id = rc.concept_id JOIN rp ON rp.resource_id = rc.resource_id AND rp.concept_id = rc.concept_id)"""


@query(f"WITH {_RES} SELECT concept_id, resource_id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, resource_id) AS rank FROM sc) z WHERE rank <= 5")
def top_14_mth_13_jn_20_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents as resources of each concept, for a learner who begins: coverage, notation, prerequisites, pace, evidence."""
    d = table(spark, sf_dir, "documents")
    r = d.select(F.col("doc_id").alias("resource_id"), "concept_ids", F.lower(F.coalesce("text", F.lit(""))).alias("low"), ((F.coalesce("n_chars", F.lit(0)) % 100) / 100.0).alias("difficulty"), F.col("lang").isNotNull().alias("transcript"), F.when(F.col("source").isNull(), 0.5).otherwise(0.9).alias("confidence"))
    pre = table(spark, sf_dir, "prerequisite_links").groupBy(F.col("target_concept_id").alias("concept_id")).agg(F.collect_set("source_concept_id").alias("pre"))
    c = table(spark, sf_dir, "concepts").select("concept_id", F.lower(F.trim("canonical_name")).alias("name")).dropDuplicates(["concept_id"])
    x = r.withColumn("concept_id", F.explode(F.array_distinct("concept_ids"))).join(c, "concept_id").join(pre, "concept_id", "left")
    said = (F.length("name") > 0) & F.contains("low", F.col("name"))
    n = F.size(F.array_intersect(F.coalesce("pre", F.array().cast("array<string>")), "concept_ids"))
    s = x.select("concept_id", "resource_id", F.round(N.resource_score(F.when(said, 0.95).otherwise(0.70), F.lit(0.75), n, F.lit(0.30), F.col("difficulty"), F.col("confidence"), F.col("transcript"), digits=None) + 1e-9, 3).alias("score"))
    w = Window.partitionBy("concept_id").orderBy(F.col("score").desc(), "resource_id")
    return s.withColumn("rank", F.row_number().over(w)).filter("rank <= 5")


# ---------------------------------------------------------------- blocks

HEIGHT, WIDTH = 792.0, 612.0


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents as blocks of pages of 34, with made-up places, fonts and sizes."""
    d = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    b = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    row = F.col("k") % 34
    return b.select(
        "doc_id", "k", "text", F.floor(F.col("k") / 34).cast("int").alias("page_index"), (F.lit(40.0) + 22.0 * row).alias("y0"), F.when(F.col("k") % 19 == 7, 700.0).otherwise(50.0).alias("x0"),
        F.when(F.length("text") < 40, 14.0).otherwise(11.0).alias("size"), F.when(F.col("k") % 11 == 3, "Helvetica-Bold").when(F.col("k") % 13 == 5, "Courier").when(F.col("k") % 17 == 6, "CMSY10").otherwise("Times").alias("font"), (F.col("k") % 23 == 9).alias("white"),
    )


BLOCKS = """bl AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, lines[k] AS text FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL) z) y),
b AS (SELECT *, CAST(k // 34 AS INTEGER) AS page_index, 40.0::DOUBLE + 22.0 * (k % 34) AS y0, CASE WHEN k % 19 = 7 THEN 700.0 ELSE 50.0 END AS x0, CASE WHEN length(text) < 40 THEN 14.0 ELSE 11.0 END AS size, CASE WHEN k % 11 = 3 THEN 'Helvetica-Bold' WHEN k % 13 = 5 THEN 'Courier' WHEN k % 17 = 6 THEN 'CMSY10' ELSE 'Times' END AS font, k % 23 = 9 AS white FROM bl)"""
_LIST = r"^(\d+[.)]|[a-zA-Z][.)]|[\x{2022}\x{25e6}\x{2013}\x{2014}*-])\s+"


@query(rf"""WITH {BLOCKS}, t AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) AS s, size / 11.0 AS ratio, contains(lower(font), 'bold') AS bold FROM b)
SELECT doc_id, k, CASE WHEN regexp_matches(s, '{_LIST}') THEN 'list_item' WHEN contains(lower(font), 'courier') THEN 'code' WHEN ratio >= 1.15 OR bold OR (regexp_matches(s, '^\d+(\.\d+)*\s+[A-Z]') AND length(s) < 100) THEN 'heading' ELSE 'paragraph' END AS type,
CASE WHEN regexp_matches(s, '{_LIST}') OR contains(lower(font), 'courier') THEN NULL WHEN ratio >= 1.15 OR bold OR (regexp_matches(s, '^\d+(\.\d+)*\s+[A-Z]') AND length(s) < 100) THEN CASE WHEN ratio >= 1.6 OR (ratio >= 1.3 AND bold) THEN 'heading_l1' WHEN ratio >= 1.25 OR bold THEN 'heading_l2' ELSE 'heading_l3' END ELSE 'body' END AS role FROM t""")
def prj_07_block_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists by their marks, code by its font, headings by size, weight or number; the rest are paragraphs."""
    kind, role = T.block_type(F.col("text"), F.col("size"), F.col("font"), F.lit(11.0))
    return blocks(spark, sf_dir).select("doc_id", "k", kind.alias("type"), role.alias("role"))


@query(rf"""WITH {BLOCKS}, t AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) AS s FROM b) SELECT doc_id, k, role FROM (SELECT doc_id, k, CASE WHEN s = '' THEN NULL WHEN y0 >= 0.85 * 792 AND regexp_matches(s, '^([*\d†‡§]+|\(\d+\))\s+[A-Z]') THEN 'footnote' WHEN regexp_matches(s, '(\.{{3,}}|…)\s*\d+\s*$') OR regexp_matches(s, '(?i)^(Contents|Table of Contents)$') THEN 'toc'
WHEN regexp_matches(s, '^[A-Z][a-zA-Z0-9\s-]{{2,30}}\s*[:—-]\s+[A-Z]') AND length(s) < 250 THEN 'glossary_entry' WHEN regexp_matches(s, '^(\[\d+\]|\d+\.)\s+[A-Z][a-z]+,') OR regexp_matches(s, '(?i)^(References|Bibliography)$') THEN 'bibliography' WHEN regexp_matches(s, '(?i)^(Example|Worked Example)\s+\d+') THEN 'worked_example'
WHEN regexp_matches(s, '(?i)^(Exercise|Problem|Practice Question)\s+\d+') THEN 'exercise' WHEN regexp_matches(s, '(?i)^(Note|Remember|Key Point|Tip|Warning):\s+') THEN 'sidebar' END AS role FROM t) z""")
def prj_08_structure_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lines are in the structure of a textbook, footnotes by their place on the page; the first rule that holds counts."""
    return blocks(spark, sf_dir).select("doc_id", "k", T.structure_role(F.col("text"), F.col("y0"), F.lit(HEIGHT)).alias("role"))


_MATH = r"[\x{2200}-\x{22FF}\x{2A00}-\x{2AFF}\x{2100}-\x{214F}\x{0370}-\x{03FF}=+\-*/^√∫∑∏αβγδεθλπσωΔ∇]"


@query(rf"""WITH {BLOCKS}, t AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) AS s FROM b), m AS (SELECT *, s <> '' AND (regexp_matches(lower(font), 'math|cmex|cmsy|symbol') OR (length(s) - length(regexp_replace(s, '{_MATH}', '', 'g'))) / length(s) >= 0.25 OR regexp_matches(s, '^(\([0-9]+(\.[0-9]+)*\)|Eq\.\s*[0-9]+)$')) AS math FROM t)
SELECT doc_id, k, CASE WHEN length(s) <= 150 THEN '$$' || replace(replace(replace(replace(replace(replace(replace(replace(replace(s, '√', '\sqrt'), '∫', '\int'), '∑', '\sum'), 'α', '\alpha'), 'β', '\beta'), 'θ', '\theta'), 'π', '\pi'), 'λ', '\lambda'), 'Δ', '\Delta') || '$$' END AS latex FROM m WHERE math""")
def prj_09_10_math_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of mathematics by font, share of symbols or a lone number, and what can be written as LaTeX."""
    b = blocks(spark, sf_dir).filter(T.is_math_block(F.col("text"), F.col("font")))
    return b.select("doc_id", "k", T.as_latex(F.col("text")).alias("latex"))


@query(rf"""WITH {BLOCKS}, t AS (SELECT *, trim(text, ' ' || chr(9) || chr(13)) AS s, 6.0 * length(text) AS w FROM b), h AS (SELECT doc_id, k, s <> '' AND (x0 + w < 0 OR x0 > 612 OR y0 + 18 < 0 OR y0 > 792 OR white) AS hidden,
 regexp_matches(s, '(?i)ignore\s+(all\s+)?previous\s+instructions|disregard\s+(all\s+)?prior\s+prompts|system\s+prompt:|you\s+are\s+now\s+an?\s+AI|override\s+system\s+rules|developer\s+mode\s+enabled') AS injection FROM t)
SELECT doc_id, k, array_to_string(list_filter([CASE WHEN hidden THEN 'HIDDEN_TEXT_DETECTED' END, CASE WHEN injection THEN 'POSSIBLE_PROMPT_INJECTION' END], lambda x: x IS NOT NULL), ',') AS warnings FROM h WHERE hidden OR injection""")
def prj_11_32_block_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks off the page or in white, and texts that give orders to a model; one flat list over all documents."""
    c = F.col
    w = T.block_warnings(c("text"), c("x0"), c("y0"), c("x0") + 6.0 * F.length("text"), c("y0") + 18.0, F.lit(WIDTH), F.lit(HEIGHT), c("white"))
    return blocks(spark, sf_dir).select("doc_id", "k", F.array_join(w, ",").alias("warnings")).filter("warnings != ''")


@query(rf"""WITH {BLOCKS}, t AS (SELECT doc_id, k, page_index, trim(text, ' ' || chr(9) || chr(13)) AS s FROM b), r AS (SELECT *, CASE WHEN regexp_matches(s, '^\d{{1,4}}$') THEN 'page_number' WHEN regexp_matches(s, '(?i)^(References|Bibliography)$') THEN 'bibliography' WHEN regexp_matches(s, '^[A-Z][a-zA-Z0-9\s-]{{2,30}}\s*[:—-]\s+[A-Z]') AND length(s) < 250 THEN 'glossary' WHEN regexp_matches(s, '(\.{{3,}}|…)\s*\d+\s*$') THEN 'toc_entry' ELSE 'body' END AS role FROM t)
SELECT doc_id, k, CASE WHEN role IN ('page_number', 'bibliography') THEN 0.0 WHEN role = 'glossary' THEN 1.5 WHEN role = 'toc_entry' THEN 0.1 ELSE 1.0 END::DOUBLE AS weight, CAST(CASE WHEN role IN ('page_number', 'bibliography') OR s = '' THEN NULL ELSE sum(CASE WHEN role NOT IN ('page_number', 'bibliography') AND s <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) END AS BIGINT) AS unit_no,
CASE WHEN role IN ('page_number', 'bibliography') OR s = '' THEN NULL ELSE 'sec_page_' || (page_index + 1) END AS section_id FROM r""")
def prj_12_16_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of each block, and the running number of those that are units; without a section they belong to their page."""
    b = blocks(spark, sf_dir).withColumn("s", F.trim(F.regexp_replace("text", r"^[ \t\r]+|[ \t\r]+$", "")))
    s = F.col("s")
    role = F.when(s.rlike(r"^\d{1,4}$"), "page_number").when(s.rlike(r"(?i)^(References|Bibliography)$"), "bibliography").when(s.rlike(r"^[A-Z][a-zA-Z0-9\s-]{2,30}\s*[:—-]\s+[A-Z]") & (F.length("s") < 250), "glossary").when(s.rlike(r"(\.{3,}|…)\s*\d+\s*$"), "toc_entry").otherwise("body")
    b = b.withColumn("weight", T.role_weight(role))
    unit = (F.col("weight") > 0) & (s != "")
    w = Window.partitionBy("doc_id").orderBy("k")  # the lines of one document
    return b.select("doc_id", "k", "weight", F.when(unit, F.sum(unit.cast("long")).over(w)).alias("unit_no"), F.when(unit, F.concat(F.lit("sec_page_"), (F.col("page_index") + 1).cast("string"))).alias("section_id"))


@query(rf"""WITH {BLOCKS}, t AS (SELECT doc_id, arg_min(trim(text, ' ' || chr(9) || chr(13)), k) FILTER (page_index = 0 AND trim(text, ' ' || chr(9) || chr(13)) <> '' AND length(text) < 40) AS title FROM b GROUP BY 1)
SELECT doc_id, coalesce(title, 'Document ' || doc_id) AS title, CASE WHEN title IS NULL THEN 'FILENAME' ELSE 'INFERRED' END AS title_source, CASE WHEN regexp_matches(lower(title), 'exam|paper|test') THEN 'question_paper' WHEN regexp_matches(lower(title), 'slide|lecture') THEN 'slides' WHEN regexp_matches(lower(title), 'worksheet|exercise') THEN 'worksheet' ELSE 'textbook' END AS genre,
CASE WHEN contains(lower(title), 'physics') THEN 'physics' WHEN contains(lower(title), 'calculus') THEN 'calculus' WHEN contains(lower(title), 'biology') THEN 'biology' WHEN contains(lower(title), 'chemistry') THEN 'chemistry' WHEN contains(lower(title), 'finance') THEN 'finance' WHEN contains(lower(title), 'economics') THEN 'economics' WHEN contains(lower(title), 'computer science') THEN 'computer science' END AS domain FROM t""")
def prj_13_31_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title of each document (its first heading on the first page, else by its name), and what it is by that title."""
    s = F.regexp_replace("text", r"^[ \t\r]+|[ \t\r]+$", "")
    b = blocks(spark, sf_dir).withColumn("s", s).withColumn("t", F.when((F.col("page_index") == 0) & (F.col("s") != "") & (F.length("text") < 40), F.struct("k", "s")))
    t = b.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", F.col("t.s").alias("title"))
    genre, domain = T.title_profile(F.col("title"))
    return t.select("doc_id", F.coalesce("title", F.concat(F.lit("Document "), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("title").isNull(), "FILENAME").otherwise("INFERRED").alias("title_source"), genre.alias("genre"), domain.alias("domain"))
