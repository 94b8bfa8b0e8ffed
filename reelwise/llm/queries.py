"""The registered queries of this subpackage, one per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


TOKENIZER = "piece_bpe_32k.model"


@query("op1_sentencepiece")
def op1_sentencepiece(spark: SparkSession, folder: str, model: str | None = None) -> DataFrame:
    from reelwise.llm.sentencepieces import encode, read_model

    if model is None:
        import public_tokenizers

        model = public_tokenizers.path(TOKENIZER)
    coded = encode(table(spark, folder, "documents").select("doc_id", "text"), read_model(model))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


WORDS = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
p AS (SELECT r, w, unnest(range(len(w) - 34)) AS s FROM d WHERE len(w) >= 35),
g AS (SELECT r, s, md5(array_to_string(w[s + 1 : s + 35], ' ')) AS h FROM p),
rep AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT r, s + unnest(range(35)) AS k FROM g JOIN rep USING (h)),
cov AS (SELECT r, list(k) AS ks FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ks IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ks, i - 1)), ' ') END) AS kept_sha256
FROM d LEFT JOIN cov USING (r)
"""


@query("op2_substrings", OP2_SQL)
def op2_substrings(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.substrings import remove_repeats

    done = remove_repeats(table(spark, folder, "documents").select("doc_id", "text"), window=35)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, r, unnest(s) AS line, unnest(range(len(s))) AS p FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, top IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN many USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query("op7_lines", OP7_SQL)
def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.lines import dedup_lines

    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i + 1 : i + 3], ' ')) AS g FROM (
  SELECT doc_id, w, unnest(range(greatest(len(w) - 2, least(len(w), 1)))) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
rare AS (SELECT * FROM (SELECT s.*, n.n, row_number() OVER (PARTITION BY doc_id ORDER BY c, g) AS k
  FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS c FROM s GROUP BY g) USING (g)) WHERE k <= n - ceil(0.85 * n) + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b USING (g) WHERE a.doc_id < b.doc_id),
links AS (SELECT a, b FROM (SELECT a, b, na, nb, count(*) AS m FROM cand JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND x.g = y.g
  GROUP BY a, b, na, nb) WHERE 100 * m >= 85 * (na + nb - m)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.least AS component_id, d.doc_id = c.least AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS least FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op9_near_duplicates", OP9_SQL)
def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.neardups import near_duplicates

    done = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"), shingle=3, percent=85)
    return done.select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s + 1 : s + 10], ' ') AS g FROM (
  SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
p AS (SELECT r, n, s, array_to_string(w[s + 1 : s + n], ' ') AS g FROM (
  SELECT r, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS s FROM d, (SELECT DISTINCT n FROM q))),
m AS (SELECT r, s, p.n, item_id FROM p JOIN q ON p.g = q.g AND p.n = q.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, s + unnest(range(n)) AS k FROM m) GROUP BY r),
own AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS i FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)
"""


@query("op4_decontamination", OP4_SQL)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.contamination import contamination

    done = contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), window=10)
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.quality import quality_rules

    done = quality_rules(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality"))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "held_out")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.nbsvm import quality_scores

    done = quality_scores(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality"))
    return done.select("doc_id", "held_out", "score", "predicted")


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.language import languages

    done = languages(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return done.select("doc_id", "held_out", "lang_pred", "score")


@query("op8_secrets")
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.secret_scan import secrets

    done = secrets(table(spark, folder, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return done.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.toxicity import toxicity

    done = toxicity(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "toxic"))
    return done.select("doc_id", "held_out", "score", "predicted", "evidence")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
t AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, quality, toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(d.text) - length(regexp_replace(d.text, '[A-Z]', '', 'g'))) > 3 * length(d.text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d JOIN t USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM x a, x b, x c, x d, x e
  WHERE a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS b, list_sum(bits[1 : step - 1])::INT AS e FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, b,
    coalesce(sum(n) FILTER (mask & (b | coalesce(e, 0)) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & coalesce(e, 0) = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & b <> 0 AND mask & coalesce(e, 0) <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (mask = b), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & b <> 0 AND mask & coalesce(e, 0) = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & b <> 0 AND mask & coalesce(e, 0) = 0), 0)::BIGINT AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, b))::BIGINT AS shapley
FROM r
"""


@query("op12_filter_audit", OP12_SQL)
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.filter_audit import filter_audit

    return filter_audit(table(spark, folder, "documents").select("doc_id", "lang", "text"), table(spark, folder, "labels"))


@query("op13_whitening")
def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.whitening import fit_whitening, whiten

    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    model = fit_whitening(vectors, components=16)
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>")
    done = whiten(vectors, model).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return done.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


@query("op11_personal")
def op11_personal(spark: SparkSession, folder: str) -> DataFrame:
    from reelwise.llm.personal import KINDS, personal_data

    done = personal_data(table(spark, folder, "documents").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.expr(f"size(filter(base, x -> x.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return done.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
