"""Best items of text profiles from blocks of texts, read in the order of score bounds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelwise.functions.columns import steady
from reelwise.functions.ordering import ordinal
from reelwise.operators.ranked import list_quotas, rank_lists
from reelwise.operators.tiles import sparse_products
from reelwise.session import cut_lineage

BLOCKS = 4096  # per kind, about: a block holds as many texts as their number asks for, and fewer texts need no bounds
SLACK = 2e-9  # more than the rounding of compared scores

KIND = ["is_known"]
LIST = ["is_known", "text_id", "category"]  # items of one list have equal scores for every user


@dataclass
class TextLists:
    """Catalog `entries` (item_id, is_known, text_id, category) met by history `shares` (user_id, text_id, share) under a quota per kind."""

    entries: DataFrame
    weights: DataFrame
    shares: DataFrame
    tastes: DataFrame
    users: DataFrame
    seen: DataFrame
    k: int
    bonus: float
    block: int | None = None
    products: DataFrame | None = None  # (user_id, text_id, score), where the texts are few

    def __post_init__(self):
        known, cold = list_quotas(self.k)
        self.quota = F.when(F.col("is_known"), F.lit(known)).otherwise(F.lit(cold))
        self.entries = cut_lineage(rank_lists(self.entries, LIST, ["item_id"], settle=False))
        self.lists = cut_lineage(self.entries.groupBy(*LIST).agg(F.count("*").alias("size")))
        met = self.seen.join(self.users, "user_id", "left_semi").join(self.entries.select("item_id", *LIST), "item_id")
        self.met = cut_lineage(met.groupBy("user_id", *LIST).agg(F.count("*").alias("met")))

    def near(self) -> DataFrame:
        """(user_id, text_id, score): every profile's products with the texts that share a term, where the texts are few.

        Matrix products give the texts' products with each other, then every profile's products: a profile is a sum of
        texts with its shares.
        """
        pack = lambda df, key, term, weight: df.groupBy(key).agg(F.collect_list(term).alias("terms"), F.collect_list(weight).alias("weights"))
        # At most BLOCKS texts come here.
        packed = pack(self.weights, "text_id", "term", "weight")
        texts = cut_lineage(packed.withColumn("item_id", F.row_number().over(W.orderBy("text_id")).cast("long")))
        ours = texts.join(self.lists.select("text_id").distinct(), "text_id", "left_semi").select("item_id", "terms", "weights")
        past = texts.join(self.shares.select("text_id").distinct(), "text_id", "left_semi")
        alike = sparse_products(past.select(F.col("item_id").alias("user_id"), "terms", "weights"), ours)
        profiles = pack(self.shares.join(texts.select("text_id", F.col("item_id").cast("string").alias("term")), "text_id"), "user_id", "term", "share")
        sums = sparse_products(profiles, pack(alike, "item_id", F.col("user_id").cast("string"), "score"))
        return sums.join(texts.select("item_id", "text_id"), "item_id").select("user_id", "text_id", "score")

    def exact(self) -> DataFrame:
        """What `scored` gives for all lists that share a term, where the texts are few."""
        rows = self.near().join(self.lists, "text_id").join(self.met, ["user_id", *LIST], "left")
        return rows.select("user_id", *LIST, "size", F.coalesce("met", F.lit(0)).alias("met"), "score")

    def make_text_blocks(self) -> None:
        """Every text is a block of its own, whose products with the profiles are known."""
        self.products = cut_lineage(self.near())
        self.lists = cut_lineage(self.lists.withColumn("block", F.xxhash64("text_id")))

    def make_blocks(self, texts: int) -> None:
        """Number the lists' blocks, list per block and term the weights and the largest one, and sum the profiles (user_id, term, p)."""
        per_block = self.block or max(1, -(-texts // BLOCKS))
        # Texts that share their heaviest term stand side by side, so that a block's bounds are tight.
        head = self.weights.groupBy("text_id").agg(F.max_by("term", F.struct("weight", "term")).alias("head"))
        named = self.lists.select(*KIND, "text_id").distinct().join(head, "text_id", "left")
        placed = ordinal(named.select(*KIND, "text_id", F.coalesce("head", F.lit("")).alias("head")), ["head", "text_id"], "at", KIND)
        numbered = placed.select(*KIND, "text_id", F.floor((F.col("at") - 1) / F.lit(per_block)).cast("long").alias("block"))
        self.lists = cut_lineage(self.lists.join(numbered, [*KIND, "text_id"]))
        terms = self.shares.join(self.weights, "text_id").groupBy("user_id", "term")
        self.profiles = cut_lineage(terms.agg(F.sum(F.col("share") * F.col("weight")).alias("p")))
        near = F.collect_list(F.struct("text_id", "weight"))  # one entry per text of the block
        members = self.lists.select(*KIND, "block", "text_id").distinct()
        self.postings = cut_lineage(
            self.weights.join(members, "text_id").groupBy(*KIND, "block", "term").agg(F.max("weight").alias("top"), near.alias("near"))
        )

    def bounds(self) -> DataFrame:
        """(user_id, kind, block, bound, left): blocks that can score above 0, and their number of unseen items."""
        if self.products is not None:
            places = self.lists.select(*KIND, "block", "text_id").distinct()
            bound = self.products.join(places, "text_id").select("user_id", *KIND, "block", F.col("score").alias("part"))
            if self.bonus:
                # Any block may hold a liked category; which ones do is asked of the blocks that matter only.
                liked = self.tastes.select("user_id").distinct().crossJoin(places.select(*KIND, "block").distinct())
                bound = bound.unionByName(liked.withColumn("part", F.lit(float(self.bonus))))
        else:
            text = self.profiles.join(self.postings.select(*KIND, "block", "term", "top"), "term")
            bound = text.select("user_id", *KIND, "block", (F.col("p") * F.col("top")).alias("part"))
        if self.bonus and self.products is None:
            liked = self.lists.select(*KIND, "block", "category").distinct().join(self.tastes, "category")
            bound = bound.unionByName(liked.select("user_id", *KIND, "block", F.lit(float(self.bonus)).alias("part")).distinct())
        keys = ["user_id", *KIND, "block"]
        items = self.lists.groupBy(*KIND, "block").agg(F.sum("size").alias("items"))
        met = self.met.join(self.lists, LIST).groupBy(*keys).agg(F.sum("met").alias("met"))
        return (
            bound.groupBy(*keys)
            .agg(F.sum("part").alias("bound"))
            .join(items, [*KIND, "block"])
            .join(met, keys, "left")
            .select(*keys, "bound", (F.col("items") - F.coalesce("met", F.lit(0))).alias("left"))
        )

    def scored(self, pairs: DataFrame) -> DataFrame:
        """(user_id, list, size, met, score) of every list in the given (user_id, kind, block)."""
        keys = ["user_id", *KIND, "block"]
        pairs = pairs.select(*keys)
        rows = pairs.join(self.lists, [*KIND, "block"])
        if self.products is not None:
            rows = rows.join(self.products, ["user_id", "text_id"], "left")
        else:
            shared = (
                self.profiles.join(self.postings.select(*KIND, "block", "term", "near"), "term")
                .join(pairs, keys)
                .select("user_id", *KIND, "p", F.inline("near"))
                .groupBy("user_id", *KIND, "text_id")
                .agg(F.sum(F.col("p") * F.col("weight")).alias("score"))
            )
            rows = rows.join(shared, ["user_id", *KIND, "text_id"], "left")
        score = F.coalesce("score", F.lit(0.0))
        if self.bonus:
            rows = rows.join(self.tastes.withColumn("_liked", F.lit(float(self.bonus))), ["user_id", "category"], "left")
            score = score + F.coalesce("_liked", F.lit(0.0))
        return rows.join(self.met, ["user_id", *LIST], "left").select(
            "user_id", *LIST, "size", F.coalesce("met", F.lit(0)).alias("met"), score.alias("score")
        )

    def best(self) -> DataFrame:
        """(user_id, item_id, is_known, score): the best unseen items of each kind, at least its quota where there are as many."""
        person = ["user_id", *KIND]
        by_bound = W.partitionBy(*person).orderBy(F.desc("bound"), F.asc("block")).rowsBetween(W.unboundedPreceding, -1)
        texts = self.weights.select("text_id").distinct().count()
        few = texts <= BLOCKS and self.block is None
        if few and not self.bonus:
            return self.taken(cut_lineage(self.exact().withColumn("s", steady("score"))))
        if few:
            self.make_text_blocks()
        else:
            self.make_blocks(texts)
        plan = cut_lineage(self.bounds().withColumn("first", F.coalesce(F.sum("left").over(by_bound), F.lit(0)) < self.quota))
        early = cut_lineage(self.scored(plan.filter("first")))
        by_score = W.partitionBy(*person).orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, 0)
        left = F.col("size") - F.col("met")
        filled = early.withColumn("s", steady("score")).withColumn("upto", F.sum(left).over(by_score))
        least = filled.filter(F.col("upto") >= self.quota).groupBy(*person).agg(F.max("s").alias("least"))
        late = plan.filter("NOT first").join(least, person, "left").filter(F.coalesce(F.col("bound") >= F.col("least") - SLACK, F.lit(True)))
        return self.taken(cut_lineage(early.unionByName(self.scored(late)).withColumn("s", steady("score"))))

    def taken(self, scored: DataFrame) -> DataFrame:
        """The items of the best lists: those above which fewer than `quota` unseen items stand."""
        person = ["user_id", *KIND]
        by_score = W.partitionBy(*person).orderBy(F.desc("s")).rangeBetween(W.unboundedPreceding, 0)
        ties, left = W.partitionBy(*person, "s"), F.col("size") - F.col("met")
        above = F.sum(left).over(by_score) - F.sum(left).over(ties)
        needed = scored.withColumn("above", above).filter((F.col("above") < self.quota) & (left > 0))
        ranks = F.sequence(F.lit(1).cast("long"), F.least(F.col("size"), self.quota + F.col("met")).cast("long"))
        listed = (
            needed.select("user_id", *LIST, "score", F.explode(ranks).alias("list_rank"))
            .join(self.entries, [*LIST, "list_rank"])
            .select("user_id", "item_id", "is_known", "score")
        )
        found = listed.unionByName(self.unscored(scored.filter("s > 0").groupBy(*person).agg(F.sum(left).alias("good"))))
        one = found.groupBy("user_id", "item_id", "is_known").agg(F.max("score").alias("score"))
        return one.join(self.seen, ["user_id", "item_id"], "left_anti")

    def unscored(self, positive: DataFrame) -> DataFrame:
        """Score 0 for the first items by id, where fewer unseen ones than the quota score above 0.

        Fewer than `quota` of the first items can score, and `met` are seen, so 2 * quota + met ids hold enough others.
        """
        person = ["user_id", *KIND]
        kinds = F.explode(F.array(F.lit(True), F.lit(False))).alias("is_known")
        short = (
            self.users.select("user_id", kinds)
            .join(positive, person, "left")
            .filter(F.coalesce("good", F.lit(0)) < self.quota)
            .join(self.met.groupBy(*person).agg(F.sum("met").alias("met")), person, "left")
        )
        ranks = F.sequence(F.lit(1).cast("long"), (2 * self.quota + F.coalesce("met", F.lit(0))).cast("long"))
        by_id = rank_lists(self.entries.select("item_id", *KIND), KIND, ["item_id"])
        asked = short.select(*person, F.explode(ranks).alias("list_rank"))
        return asked.join(by_id, [*KIND, "list_rank"]).select("user_id", "item_id", "is_known", F.lit(0.0).alias("score"))
