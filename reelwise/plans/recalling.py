"""Queries of the recall channels."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelwise.functions.columns import as_date
from reelwise.operators import ranked as RK
from reelwise.operators import recall as RC
from reelwise.operators import subspace as SB
from reelwise.operators import text as TX
from reelwise.operators import vectors as V
from reelwise.plans.registry import register
from reelwise.plans.sql import fragment, query, r6, rx, unit_hash
from reelwise.plans.world import World
from reelwise.session import cut_lineage
from reelwise.sources import driver_tables as D

K = 20
LENGTH = 50


def tail_fragment(prefix: str) -> None:
    fragment(
        f"{prefix}tail",
        [f"{prefix}train"],
        f"""
SELECT user_id, item_id, r - 1 AS pos FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, event_id DESC) AS r
  FROM {prefix}train WHERE label_complete = 1
) WHERE r <= {LENGTH}""",
    )


for _prefix in ("", "o", "e"):
    tail_fragment(_prefix)


# --- popularity -------------------------------------------------------------------------------

WEIGHT = "(1 + label_complete + label_strong - 0.5 * label_short)"
LAST = "(SELECT max(strptime(CAST(date AS VARCHAR), '%Y%m%d')) FROM {log})"
AGE = "date_diff('day', strptime(CAST(date AS VARCHAR), '%Y%m%d'), " + LAST + ")"


def popular_sql(name: str, log: str, score: str, where: str = "true") -> None:
    fragment(name, [log], f"SELECT item_id, {score.format(log=log)} AS score FROM {log} WHERE {where.format(log=log)} GROUP BY 1")


popular_sql("pop_all", "train", f"sum({WEIGHT})")
popular_sql("pop_week", "train", f"sum({WEIGHT})", AGE + " <= 6")
popular_sql("pop_decay", "train", f"sum({WEIGHT} * exp(-({AGE}) / 7.0::DOUBLE))")


def first_unseen_sql(scores: str, users: str, seen: str, k: int) -> str:
    return f"""
SELECT user_id, item_id, CAST(r AS INTEGER) AS rank FROM (
  SELECT u.user_id, s.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY round(s.score, 9) DESC, s.item_id) AS r
  FROM {users} u CROSS JOIN {scores} s
  WHERE NOT EXISTS (SELECT 1 FROM {seen} x WHERE x.user_id = u.user_id AND x.item_id = s.item_id)
) WHERE r <= {k}"""


@register("popular_scores_decayed", query(["pop_decay"], f"SELECT item_id, {r6('score')} FROM pop_decay"))
def popular_scores_decayed(spark, folder):
    return RC.popular_scores(World(spark, folder).train, decay=True)


@register("popular_recall", query(["pop_all", "users", "seen"], first_unseen_sql("pop_all", "users", "seen", K)))
def popular_recall(spark, folder):
    w = World(spark, folder, prepared=True)
    return RC.recommend_ranked(RC.popular_scores(w.train), w.users, w.train, K)


@register("popular_window", query(["pop_week", "users", "seen"], first_unseen_sql("pop_week", "users", "seen", K)))
def popular_window(spark, folder):
    w = World(spark, folder, prepared=True)
    return RC.recommend_ranked(RC.popular_scores(w.train, window_days=7), w.users, w.train, K)


@register(
    "popular_decayed",
    query(
        ["pop_decay", "users", "seen", "items"],
        first_unseen_sql(
            "(SELECT * FROM pop_decay WHERE item_id IN (SELECT item_id FROM items WHERE first_category <= 12))",
            "users",
            "seen",
            K,
        ),
    ),
)
def popular_decayed(spark, folder):
    """Decayed popularity within an allowed catalog."""
    w = World(spark, folder, prepared=True)
    allowed = w.items.filter("first_category <= 12")
    return RC.recommend_ranked(RC.popular_scores(w.train, decay=True), w.users, w.train, K, allowed)


popular_sql("opop", "otrain", f"sum({WEIGHT})")


@register(
    "popular_recall_large",
    query(
        ["opop", "ousers", "oseen"],
        """
SELECT user_id, item_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS rank
FROM ousers u CROSS JOIN (SELECT * FROM opop) s
WHERE NOT EXISTS (SELECT 1 FROM oseen x WHERE x.user_id = u.user_id AND x.item_id = s.item_id)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) <= 50""",
    ),
)
def popular_recall_large(spark, folder):
    w = World(spark, folder, "orders")
    return RC.recommend_ranked(RC.popular_scores(w.train), w.users, w.train, 50)


# --- item CF ------------------------------------------------------------------------------------


def cf_fragments(prefix: str, tag: str, weights: str, iuf: bool, neighbors: int) -> None:
    p = prefix
    fragment(
        f"{tag}_hist",
        [f"{p}tail", f"{p}train"],
        f"""
SELECT t.user_id, t.item_id, t.pos, {'w.weight' if weights == 'multi' else '1.0::DOUBLE'} AS weight FROM {p}tail t
JOIN (SELECT user_id, item_id, max(1.0 + label_strong - 0.5 * label_short)::DOUBLE AS weight FROM {p}train
  WHERE label_complete = 1 GROUP BY ALL) w ON w.user_id = t.user_id AND w.item_id = t.item_id""",
    )
    fragment(
        f"{tag}_uniq",
        [f"{tag}_hist"],
        f"""
SELECT *, {'1 / ln(2 + count(*) OVER (PARTITION BY user_id))' if iuf else '1.0::DOUBLE'} AS uw
FROM (SELECT DISTINCT user_id, item_id, weight FROM {tag}_hist)""",
    )
    fragment(f"{tag}_cnt", [f"{tag}_uniq"], f"SELECT item_id, count(*) AS cnt FROM {tag}_uniq GROUP BY 1")
    fragment(
        f"{tag}_sim",
        [f"{tag}_uniq", f"{tag}_cnt"],
        f"""
SELECT item_id, other_id, sim, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(sim, 9) DESC, other_id) AS rn FROM (
    SELECT p.item_id, p.other_id, p.co / sqrt(a.cnt * b.cnt) AS sim FROM (
      SELECT x.item_id, y.item_id AS other_id, sum(x.uw * sqrt(x.weight * y.weight)) AS co
      FROM {tag}_uniq x JOIN {tag}_uniq y ON y.user_id = x.user_id AND y.item_id <> x.item_id GROUP BY ALL
    ) p JOIN {tag}_cnt a ON a.item_id = p.item_id JOIN {tag}_cnt b ON b.item_id = p.other_id
  )
) WHERE rn <= {neighbors}""",
    )


def cf_recommend_sql(prefix: str, tag: str, k: int, decay: bool = True, allowed: str = "true") -> tuple[str, str]:
    """(scored fragment, list fragment) names' SQL."""
    fade = "pow(0.9, h.pos)" if decay else "1.0::DOUBLE"
    scored = f"""
SELECT user_id, item_id, score, r FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
    SELECT h.user_id, s.other_id AS item_id, sum({fade} * h.weight * s.sim) AS score
    FROM {tag}_hist h JOIN {tag}_sim s ON s.item_id = h.item_id
    WHERE {allowed.format(item='s.other_id')}
      AND NOT EXISTS (SELECT 1 FROM {prefix}seen x WHERE x.user_id = h.user_id AND x.item_id = s.other_id)
    GROUP BY ALL
  )
) WHERE r <= {k}"""
    full = f"""
SELECT user_id, item_id, score, CAST(row_number() OVER (PARTITION BY user_id ORDER BY tier, o, item_id) AS INTEGER) AS rank FROM (
  SELECT user_id, item_id, score, 0 AS tier, r AS o FROM {tag}_scored
  UNION ALL
  SELECT u.user_id, c.item_id, NULL, 1, -c.cnt FROM {prefix}users u CROSS JOIN {tag}_cnt c
  WHERE {allowed.format(item='c.item_id')}
    AND NOT EXISTS (SELECT 1 FROM {prefix}seen x WHERE x.user_id = u.user_id AND x.item_id = c.item_id)
    AND NOT EXISTS (SELECT 1 FROM {tag}_scored x WHERE x.user_id = u.user_id AND x.item_id = c.item_id)
) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, o, item_id) <= {k}"""
    return scored, full


def cf_list_fragments(prefix: str, tag: str, k: int, decay: bool = True, allowed: str = "true") -> None:
    scored, full = cf_recommend_sql(prefix, tag, k, decay, allowed)
    fragment(f"{tag}_scored", [f"{tag}_hist", f"{tag}_sim", f"{prefix}seen"], scored)
    fragment(f"{tag}_list", [f"{tag}_scored", f"{tag}_cnt", f"{prefix}users"], full)


cf_fragments("", "cf", "one", True, 200)
cf_list_fragments("", "cf", K)
cf_fragments("", "cfm", "multi", True, 30)
cf_list_fragments("", "cfm", K, decay=False)
cf_fragments("o", "cfo", "one", True, 200)
cf_list_fragments("o", "cfo", 100)
cf_fragments("e", "cfe", "one", True, 200)
cf_list_fragments("e", "cfe", 50)


def itemcf(w: World, k: int, neighbors: int = 200, feedback: str = "complete", decay: bool = True):
    history = RC.cf_history(w.train, LENGTH, feedback)
    similarity = RC.itemcf_similarity(history, neighbors)
    return RC.itemcf_recommend(similarity, history, w.users, w.seen, k, decay)


@register("itemcf_similarity", query(["cfo_sim"], f"SELECT item_id, other_id, rn, {r6('sim')} FROM cfo_sim"))
def itemcf_similarity(spark, folder):
    w = World(spark, folder, "orders")
    return RC.itemcf_similarity(RC.cf_history(w.train, LENGTH), 200).select("item_id", "other_id", "rn", "sim")


@register("itemcf_topk", query(["cf_list"], f"SELECT user_id, item_id, rank, {r6('score')} FROM cf_list"))
def itemcf_topk(spark, folder):
    return itemcf(World(spark, folder, prepared=True), K)


@register("itemcf_multifeedback", query(["cfm_list"], f"SELECT user_id, item_id, rank, {r6('score')} FROM cfm_list"))
def itemcf_multifeedback(spark, folder):
    return itemcf(World(spark, folder, prepared=True), K, 30, "multi_feedback", decay=False)


@register("itemcf_topk_large", query(["cfo_list"], f"SELECT user_id, item_id, rank, {r6('score')} FROM cfo_list"))
def itemcf_topk_large(spark, folder):
    """The larger log at list depth 100."""
    return itemcf(World(spark, folder, "orders"), 100)


# --- category -----------------------------------------------------------------------------------


def interleaved_sql(source: str, k: int, order: str) -> str:
    quota = max(1, k // 5)
    return f"""
SELECT user_id, item_id, is_known, CAST(1 + CASE WHEN is_known THEN i + least(c, i // 4 + 1)
  ELSE least(5 * i, n + i) END AS INTEGER) AS rank {', score' if source == 'scored' else ''}
FROM (
  SELECT *, count(*) FILTER (NOT is_known) OVER (PARTITION BY user_id) AS c,
    count(*) FILTER (is_known) OVER (PARTITION BY user_id) AS n
  FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id, is_known ORDER BY {order}) - 1 AS i FROM {source}
  ) WHERE i < CASE WHEN is_known THEN {k - quota} ELSE {quota} END
)"""


def category_fragment(prefix: str, name: str, k: int) -> None:
    p = prefix
    fragment(
        f"{name}_walk",
        [f"{p}items", f"{p}tail", f"{p}train", f"{p}seen"],
        f"""
SELECT user_id, item_id, is_known, r FROM (
  SELECT t.user_id, l.item_id, l.is_known, row_number() OVER (PARTITION BY t.user_id ORDER BY t.n DESC, t.c, l.cnt DESC, l.item_id) AS r
  FROM (
    SELECT user_id, coalesce(first_category, -1) AS c, count(*) AS n FROM {p}tail LEFT JOIN {p}items USING (item_id) GROUP BY ALL
  ) t JOIN (
    SELECT i.item_id, coalesce(first_category, -1) AS c, coalesce(q.cnt, 0) AS cnt, q.cnt IS NOT NULL AS is_known
    FROM {p}items i LEFT JOIN (SELECT item_id, count(*) AS cnt FROM {p}train GROUP BY 1) q ON q.item_id = i.item_id
  ) l ON l.c = t.c
  WHERE NOT EXISTS (SELECT 1 FROM {p}seen x WHERE x.user_id = t.user_id AND x.item_id = l.item_id)
)""",
    )
    fragment(f"{name}_list", [f"{name}_walk"], interleaved_sql(f"{name}_walk", k, "r"))


category_fragment("", "cat", K)
category_fragment("e", "ecat", K)


@register("category_recall", query(["cat_list"], "SELECT user_id, item_id, rank, is_known FROM cat_list"))
def category_recall(spark, folder):
    w = World(spark, folder, prepared=True)
    return RC.category_recall(w.train, w.items, w.users, w.seen, K, LENGTH)


@register("category_recall_early", query(["ecat_list"], "SELECT user_id, item_id, rank, is_known FROM ecat_list"))
def category_recall_early(spark, folder):
    """A short training window, so that many catalog items are unseen."""
    w = World(spark, folder, "early")
    return RC.category_recall(w.train, w.items, w.users, w.seen, K, LENGTH)


# --- text ---------------------------------------------------------------------------------------


def tfidf_fragment(name: str, source: str, needs: list[str]) -> None:
    fragment(
        f"{name}_tf",
        needs,
        f"""
SELECT item_id, term, count(*) AS tf FROM (
  SELECT item_id, unnest(list_concat({', '.join(
      f"list_transform(generate_series(1, len(t) - {n - 1}), lambda i: substring(t, i, {n}))" for n in (2, 3, 4)
  )})) AS term
  FROM (SELECT item_id, regexp_replace(lower(coalesce(content_text, '')), '\\s\\s+', ' ', 'g') AS t FROM {source})
) GROUP BY ALL""",
    )
    fragment(
        f"{name}_w",
        [f"{name}_tf"],
        f"""
SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM (
  SELECT f.item_id, f.term, (1 + ln(f.tf)) * (ln((1.0::DOUBLE + n) / (1 + v.df)) + 1) AS w
  FROM {name}_tf f JOIN (
    SELECT term, count(*) AS df, sum(tf) AS freq FROM {name}_tf GROUP BY 1 HAVING count(*) >= 2
  ) v ON v.term = f.term, (SELECT count(*) AS n FROM {source}) c
)""",
    )


fragment("docs", [], "SELECT doc_id AS item_id, text AS content_text FROM documents")
tfidf_fragment("doc", "docs", ["docs"])
tfidf_fragment("part", "items", ["items"])


@register("tfidf_weights", query(["doc_w"], f"SELECT item_id, term, {r6('weight')} FROM doc_w"))
def tfidf_weights(spark, folder):
    """Whole document texts."""
    return TX.tfidf_weights(D.document_items(spark, folder))


def text_fragment(name: str, k: int, bonus: float) -> None:
    fragment(
        f"{name}_profile",
        ["tail", "items", "part_w"],
        """
SELECT h.user_id, w.term, sum(w.weight) / any_value(h.n) AS weight
FROM (SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n FROM tail SEMI JOIN items USING (item_id)) h
JOIN part_w w ON w.item_id = h.item_id GROUP BY ALL""",
    )
    fragment(
        f"{name}_walk",
        [f"{name}_profile", "seen", "train"],
        f"""
SELECT user_id, item_id, score, item_id IN (SELECT item_id FROM train) AS is_known, r FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
    SELECT u.user_id, i.item_id, coalesce(d.s, 0) + {bonus} * (c.user_id IS NOT NULL)::INT AS score
    FROM (SELECT DISTINCT user_id FROM tail SEMI JOIN items USING (item_id)) u CROSS JOIN items i
    LEFT JOIN (
      SELECT p.user_id, w.item_id, sum(p.weight * w.weight) AS s FROM {name}_profile p JOIN part_w w ON w.term = p.term GROUP BY ALL
    ) d ON d.user_id = u.user_id AND d.item_id = i.item_id
    LEFT JOIN (
      SELECT DISTINCT user_id, first_category FROM tail JOIN items USING (item_id) WHERE first_category <> -1
    ) c ON c.user_id = u.user_id AND c.first_category = i.first_category
    WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = i.item_id)
  )
)""",
    )
    fragment(
        f"{name}_list",
        [f"{name}_walk"],
        interleaved_sql(f"{name}_walk", k, "r").replace("AS rank ", "AS rank, score "),
    )


text_fragment("txt", K, 0.0)
text_fragment("txc", K, 0.15)


def text_lists(w: World, bonus: float):
    items = D.part_texts(w.spark, w.folder)
    members, weights = TX.text_weights(items)
    return TX.text_recall(weights, w.train, items, w.users, w.seen, K, LENGTH, bonus, members=members)


@register("text_recall", query(["txt_list"], f"SELECT user_id, item_id, rank, is_known, {r6('score')} FROM txt_list"))
def text_recall(spark, folder):
    return text_lists(World(spark, folder, prepared=True), 0.0)


@register(
    "text_category_recall", query(["txc_list"], f"SELECT user_id, item_id, rank, is_known, {r6('score')} FROM txc_list")
)
def text_category_recall(spark, folder):
    return text_lists(World(spark, folder, prepared=True), 0.15)


# --- vectors ------------------------------------------------------------------------------------

fragment(
    "user_vec",
    ["tail"],
    """
SELECT user_id, list(m ORDER BY d) AS v FROM (
  SELECT t.user_id, d.d, avg(e.embedding[d.d]::DOUBLE) AS m FROM tail t JOIN embeddings e ON e.vec_id = t.item_id,
    (SELECT unnest(generate_series(1, 64)) AS d) d GROUP BY ALL
) GROUP BY 1""",
)
fragment(
    "emb_list",
    ["user_vec", "seen"],
    f"""
SELECT user_id, item_id, score, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
    SELECT u.user_id, e.vec_id AS item_id, list_dot_product(u.v, e.embedding::DOUBLE[]) AS score
    FROM user_vec u CROSS JOIN embeddings e
    WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = e.vec_id)
  )
) WHERE r <= {K}""",
)


def embedding_lists(w: World):
    """Mean embedding of the history tail against all embeddings."""
    vectors = D.embedding_items(w.spark, w.folder)
    users = V.mean_vectors(RK.positive_tail(w.train, LENGTH), vectors)
    return V.embedding_topk(users, vectors, w.seen, K)


@register("embedding_topk", query(["emb_list"], f"SELECT user_id, item_id, rank, {r6('score')} FROM emb_list"))
def embedding_topk(spark, folder):
    return embedding_lists(World(spark, folder, prepared=True)).select("user_id", "item_id", "rank", "score")


@register(
    "embedding_neighbours",
    f"""
SELECT user_id, item_id, CAST(r AS INTEGER) AS rank, {r6('score')} FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
    SELECT a.vec_id AS user_id, b.vec_id AS item_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
  )
) WHERE r <= 50""",
)
def embedding_neighbours(spark, folder):
    """Every vector against every other one, itself masked as seen."""
    vectors = D.embedding_items(spark, folder)
    users = vectors.withColumnRenamed("item_id", "user_id")
    own = vectors.select(F.col("item_id").alias("user_id"), "item_id")
    return V.embedding_topk(users, vectors, own, 50).select("user_id", "item_id", "rank", "score")


@register("als_recall")
def als_recall(spark, folder):
    w = World(spark, folder)
    out = V.als_recall(w.train, w.users, w.seen, K, rank=16, iterations=4)
    return out.select("user_id", "item_id", "rank", "score")


# --- content subspace -----------------------------------------------------------------------------

AXES, POWER = 4, 1  # of the checked queries; without oversampling the subspace is a fixed function of the postings


def cholesky_sql(source: str, key: str, n: int) -> tuple[str, str]:
    """(one row with the Cholesky factor of the Gram matrix of c1..cn, the columns made orthonormal as c1..cn)."""
    pairs = [(i, j) for i in range(1, n + 1) for j in range(1, i + 1)]
    grams = ", ".join(f"sum(c{i} * c{j}) AS g{i}_{j}" for i, j in pairs)
    factor = []
    for i, j in pairs:
        inner = "".join(f" - l{i}_{m} * l{j}_{m}" for m in range(1, j))
        factor.append(f"sqrt(g{i}_{i}{inner}) AS l{i}_{i}" if i == j else f"(g{i}_{j}{inner}) / l{j}_{j} AS l{i}_{j}")
    solved = [f"(c{i}{''.join(f' - l{i}_{m} * q{m}' for m in range(1, i))}) / l{i}_{i} AS q{i}" for i in range(1, n + 1)]
    return (
        f"SELECT {', '.join(factor)} FROM (SELECT {grams} FROM {source})",
        f"SELECT {key}, {', '.join(f'q{i} AS c{i}' for i in range(1, n + 1))} FROM (SELECT {key}, {', '.join(solved)} FROM {source}, {source}_l)",
    )


def subspace_fragments(name: str, weights: str, n: int = AXES, power: int = POWER) -> None:
    """`name`_xy: items' coordinates c1..cn on an orthonormal basis of the same subspace as subspace.leading_axes."""
    columns = range(1, n + 1)
    start = ", ".join(f"{unit_hash(2026, str(j - 1), 'term')} - 0.5::DOUBLE AS c{j}" for j in columns)
    fragment(f"{name}_z0", [weights], f"SELECT term, {start} FROM (SELECT DISTINCT term FROM {weights})")

    def product(out: str, factor: str, by: str, to: str) -> None:
        sums = ", ".join(f"sum(w.weight * f.c{j}) AS c{j}" for j in columns)
        fragment(out, [weights, factor], f"SELECT w.{to}, {sums} FROM {weights} w JOIN {factor} f ON f.{by} = w.{by} GROUP BY 1")

    def orthonormal(source: str, key: str) -> str:
        factor, solved = cholesky_sql(source, key, n)
        fragment(f"{source}_l", [source], factor)
        fragment(f"{source}_q", [source, f"{source}_l"], solved)
        return f"{source}_q"

    factor = f"{name}_z0"
    for p in range(power + 1):
        product(f"{name}_y{p}", factor, "term", "item_id")
        product(f"{name}_z{p + 1}", orthonormal(f"{name}_y{p}", "item_id"), "item_id", "term")
        factor = f"{name}_z{p + 1}"
    product(f"{name}_xy", orthonormal(factor, "term"), "term", "item_id")


subspace_fragments("docs_sub", "doc_w")
subspace_fragments("part_sub", "part_w")
SQUARES = " + ".join(f"c{j} * c{j}" for j in range(1, AXES + 1))


@register(
    "content_svd",
    query(
        ["docs_sub_xy"],
        f"""
SELECT a.item_id, {rx('a.s', 'share')}, {rx(f"({' + '.join(f'a.c{j} * b.c{j}' for j in range(1, AXES + 1))}) / sqrt(a.s * b.s)", 'next_cosine')}
FROM (SELECT *, {SQUARES} AS s FROM docs_sub_xy) a LEFT JOIN (SELECT *, {SQUARES} AS s FROM docs_sub_xy) b ON b.item_id = a.item_id + 1""",
    ),
)
def content_svd(spark, folder):
    """Whole document texts on their leading axes: the share of each TF-IDF row that the axes hold (1 less its squared
    projection error), and the cosine with the next document's content vector. Neither depends on how the axes turn."""
    postings = TX.text_postings(D.document_items(spark, folder))
    axes, values = SB.leading_axes(postings, AXES, 0, POWER)
    placed = cut_lineage(SB.project(postings, axes, len(values)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit = placed.select("item_id", dot("v", "v").alias("share"), TX.unit_vector("v").alias("u"))
    later = unit.select((F.col("item_id") - 1).alias("item_id"), F.col("u").alias("w"))
    return unit.join(later, "item_id", "left").select("item_id", "share", dot("u", "w").alias("next_cosine"))


@register(
    "content_axes",
    query(
        ["docs_sub_xy", "doc_w"],
        f"""
SELECT i::INT AS i, j::INT AS j, {rx('(i = j)::INT', 'dot')}, {rx(f'(SELECT sum({SQUARES}) FROM docs_sub_xy) / (SELECT sum(weight * weight) FROM doc_w)', 'captured')}
FROM (SELECT unnest(range({AXES})) AS i) CROSS JOIN (SELECT unnest(range({AXES})) AS j) WHERE i <= j""",
    ),
)
def content_axes(spark, folder):
    """Inner products of the axes of the documents' TF-IDF rows, and the share of the rows' squared length they hold."""
    postings = TX.text_postings(D.document_items(spark, folder))
    axes, values = SB.leading_axes(postings, AXES, 0, POWER)
    n = len(values)
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.sum(F.col("axis")[i] * F.col("axis")[j]).alias("dot")) for i in range(n) for j in range(i, n)])
    total = postings.squares().agg(F.sum("square")).scalar()
    held = SB.project(postings, axes, n).agg(sum(F.sum(F.col("v")[i] * F.col("v")[i]) for i in range(n))).scalar()
    return axes.agg(pairs.alias("p")).select(F.inline("p")).select("i", "j", "dot", (held / total).alias("captured"))


fragment(
    "item_feats",
    ["items", "part_sub_xy"],
    f"""
SELECT i.item_id, 't' || j AS f, CASE j {' '.join(f'WHEN {j} THEN c{j}' for j in range(1, AXES + 1))} END / sqrt({SQUARES}) AS v
FROM items i JOIN part_sub_xy USING (item_id), (SELECT unnest(generate_series(1, {AXES})) AS j) WHERE {SQUARES} > 0
UNION ALL SELECT item_id, 'c' || coalesce(first_category, -1), 1.0::DOUBLE FROM items
UNION ALL SELECT item_id, 'a' || ((coalesce(author_id, -1) % 64 + 64) % 64), 1.0::DOUBLE FROM items
UNION ALL SELECT item_id, 'd', (x - avg(x) OVER ()) / stddev_samp(x) OVER () FROM (SELECT item_id, ln(1 + coalesce(video_duration, 0.0::DOUBLE)) AS x FROM items)""",
)
fragment(
    "feat_list",
    ["item_feats", "tail", "seen"],
    f"""
SELECT user_id, item_id, score, r FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, item_id) AS r FROM (
    SELECT u.user_id, f.item_id, sum(u.v * f.v) AS score FROM (
      SELECT user_id, f, v / sqrt(sum(v * v) OVER (PARTITION BY user_id)) AS v FROM (
        SELECT user_id, f, sum(v) / any_value(n) AS v FROM (
          SELECT user_id, item_id, count(*) OVER (PARTITION BY user_id) AS n FROM tail SEMI JOIN items USING (item_id)
        ) JOIN item_feats USING (item_id) GROUP BY ALL)
    ) u JOIN (SELECT item_id, f, v / sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS v FROM item_feats) f ON f.f = u.f
    WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.user_id = u.user_id AND x.item_id = f.item_id)
    GROUP BY ALL
  )
) WHERE r <= {K}""",
)


@register("feature_recall", query(["feat_list"], f"SELECT user_id, item_id, CAST(r AS INTEGER) AS rank, {r6('score')} FROM feat_list"))
def feature_recall(spark, folder):
    w = World(spark, folder)
    vectors = V.item_feature_vectors(w.items, AXES, oversample=0, power=POWER)
    out = V.feature_recall(w.train, vectors, w.users, w.seen, K, LENGTH)
    return out.select("user_id", "item_id", "rank", "score")


PROFILE = {
    "is_lowactive_period": "(c_acctbal < 0)::INT::DOUBLE",
    "is_live_streamer": "0.0::DOUBLE",
    "is_video_author": "(c_nationkey = 0)::INT::DOUBLE",
    "follow_user_num": "c_nationkey::DOUBLE",
    "fans_user_num": "c_acctbal",
    "friend_user_num": "0.0::DOUBLE",
    "register_days": "c_custkey::DOUBLE",
}


def scaled_sql(x: str) -> str:
    return f"CASE WHEN stddev_samp({x}) OVER () > 0 THEN ({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER () ELSE 0.0::DOUBLE END"


@register(
    "user_features",
    query(
        ["otail"],
        f"""
SELECT user_id, CAST(d - 1 AS INTEGER) AS place, {rx('value', 'value')} FROM (
  SELECT c_custkey AS user_id, d.d, coalesce(h.m, 0) AS value FROM customer CROSS JOIN (SELECT unnest(generate_series(1, 64)) AS d) d
  LEFT JOIN (
    SELECT t.user_id, d.d, avg(e.embedding[d.d]::DOUBLE) AS m FROM otail t JOIN embeddings e ON e.vec_id = t.item_id,
      (SELECT unnest(generate_series(1, 64)) AS d) d GROUP BY ALL
  ) h ON h.user_id = c_custkey AND h.d = d.d
  UNION ALL
  SELECT user_id, unnest(generate_series(65, {64 + len(PROFILE)})), unnest([{', '.join(f'x{i}' for i in range(len(PROFILE)))}]) FROM (
    SELECT c_custkey AS user_id, {', '.join(f'{scaled_sql(x)} AS x{i}' for i, x in enumerate(PROFILE.values()))} FROM customer)
  UNION ALL
  SELECT c_custkey, {64 + len(PROFILE)} + s.r, (c_mktsegment = s.seg)::INT::DOUBLE FROM customer
  CROSS JOIN (SELECT seg, row_number() OVER (ORDER BY seg) AS r FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer)) s
)""",
    ),
)
def user_features(spark, folder):
    """Every entry of every user's feature vector."""
    w = World(spark, folder, "orders")
    vectors = D.embedding_items(spark, folder)
    out = V.user_feature_vectors(w.train, D.customer_profiles(spark, folder), vectors, 64, LENGTH)
    return out.select("user_id", F.posexplode("vector").alias("place", "value"))


# --- fusion -------------------------------------------------------------------------------------


def fused(w: World, weights: dict[str, float], k: int):
    channels = {
        "itemcf": itemcf(w, K),
        "category": RC.category_recall(w.train, w.items, w.users, w.seen, K, LENGTH),
        "embedding": embedding_lists(w),
    }
    ranked = None
    for name in weights:
        part = channels[name].select("user_id", "item_id", "rank", F.lit(name).alias("channel"))
        ranked = part if ranked is None else ranked.unionByName(part)
    return RK.quota_fuse(ranked, weights, k)


def fold_sql(shares: list[float], k: int) -> str:
    """The quota walk as a recursive query: one step per consumed list position."""
    n = len(shares)
    s = "[" + ", ".join(f"{x!r}::DOUBLE" for x in shares) + "]"
    # Claims of the channels that still have items; the first of the largest wins.
    claims = "[" + ", ".join(
        f"CASE WHEN cur[{i}] < len(lists[{i}]) THEN {s}[{i}] * (len(picked) + 1) - taken[{i}] ELSE -1e18::DOUBLE END"
        for i in range(1, n + 1)
    ) + "]"
    return f"""
SELECT user_id, unnest(picked) AS item_id, CAST(unnest(generate_series(1, len(picked))) AS INTEGER) AS rank FROM (
  SELECT user_id, arg_max(picked, step) AS picked FROM walk GROUP BY 1
)""", f"""
SELECT user_id, lists, 0 AS step, CAST([] AS BIGINT[]) AS picked, {[0] * n}::INT[] AS cur, {[0] * n}::INT[] AS taken
FROM start
UNION ALL
SELECT user_id, lists, step + 1,
  CASE WHEN fresh THEN list_append(picked, item) ELSE picked END,
  [{', '.join(f'cur[{i}] + (c = {i})::INT' for i in range(1, n + 1))}],
  [{', '.join(f'taken[{i}] + (c = {i} AND fresh)::INT' for i in range(1, n + 1))}]
FROM (
  SELECT *, lists[c][cur[c] + 1] AS item, NOT list_contains(picked, lists[c][cur[c] + 1]) AS fresh FROM (
    SELECT *, list_position(claims, list_max(claims)) AS c FROM (
      SELECT *, {claims} AS claims FROM walk WHERE len(picked) < {k}
    ) WHERE list_max(claims) > -1e17
  )
)"""


def fusion_query(weights: dict[str, float], k: int) -> str:
    lists = {"itemcf": "cf_list", "category": "cat_list", "embedding": "emb_list"}
    total = sum(weights.values())
    select, walk = fold_sql([w / total for w in weights.values()], k)
    start = " UNION ALL ".join(
        f"SELECT user_id, item_id, rank, {i} AS ch FROM {lists[name]}" for i, name in enumerate(weights, 1)
    )
    gathered = ", ".join(
        f"coalesce(list(item_id ORDER BY rank) FILTER (ch = {i}), CAST([] AS BIGINT[]))" for i in range(1, len(weights) + 1)
    )
    body = query(
        [lists[name] for name in weights], "", extra={"start": f"SELECT user_id, [{gathered}] AS lists FROM ({start}) GROUP BY 1"}
    )
    return body.replace("WITH ", "WITH RECURSIVE ", 1) + f",\nwalk AS ({walk})\n{select}"


# A claim that stops inside a run of duplicates keeps its slot in the engine; in the walk above each
# consumed duplicate is a step of its own with unchanged claims, so the same channel goes on.
QUOTAS = {"itemcf": 70.0, "category": 20.0, "embedding": 10.0}
EQUAL = {"itemcf": 1.0, "category": 1.0, "embedding": 1.0}


@register("quota_fusion", fusion_query(QUOTAS, K))
def quota_fusion(spark, folder):
    return fused(World(spark, folder, prepared=True), QUOTAS, K)


@register("equal_fusion", fusion_query(EQUAL, K))
def equal_fusion(spark, folder):
    return fused(World(spark, folder, prepared=True), EQUAL, K)


@register(
    "training_window",
    query(["log"], "SELECT split, count(*) AS rows, max(date) AS last FROM log WHERE split IN ('train', 'valid') GROUP BY 1"),
)
def training_window(spark, folder):
    """History through the validation days, for a frozen test panel."""
    log = RK.training_log(World(spark, folder).log, "valid", "test")
    return log.groupBy("split").agg(F.count("*").alias("rows"), F.max("date").alias("last"))
