"""Personal data: proposals from fixed and loose patterns, boosted trees over their format and context, calibrated thresholds.

The fixed patterns with their checks give the base spans. Loose patterns propose more, overlapping spans: addresses with
"at" and "dot" spelled out, defanged IPs, cards with other separators or fewer digits, phone numbers without "+". A
proposal that a check confirms or refutes is a labelled example; one that no check covers is open. Boosted trees learn
from the labelled ones, on features that leave the deciding mark out: an open proposal's format is read after its
spelled-out marks are normalised, a phone's after its country code. A threshold per kind, taken from labelled proposals of
documents the trees have not seen, selects open proposals. DataFrame functions only: trees grow on histograms that Spark
sums, and are applied as SQL expressions.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelwise.llm.labelled import id_remainder
from reelwise.session import cut_lineage

# The kinds in the order of a report.
KINDS = ("email", "ip", "card", "phone")
DEPTH, ROUNDS, RATE, RIDGE = 2, 12, 0.4, 1.0
BLOCK = 64
BINS = 100

def literal(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


# The fixed patterns, without backtracking: a run of local characters is tried once, from its start or from where the
# previous match ended; a card is a whole chain of 16 to 19 digits.
LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains({t}, '@')", "true"),
    "ip": (
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"{t} RLIKE '[0-9][.][0-9]++[.][0-9]'",
        "forall(split({v}, '[.]'), x -> coalesce(try_cast(x AS BIGINT) <= 255, false))",
    ),
    "card": (
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
        r"{t} RLIKE '[0-9][0-9 -]{{14}}'",
        "luhn_check(regexp_replace({v}, '[^0-9]', ''))",
    ),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')", "length(regexp_replace({v}, '[^0-9]', '')) BETWEEN 8 AND 15"),
}
# Loose patterns: (kind, pattern, guard, check, normal form). A check that is null leaves the proposal open.
DIGITS = "regexp_replace({v}, '[^0-9]', '')"
AT, DOT = r"(?:\x20?[(\[{]at[)\]}]\x20?|\x20at\x20)", r"(?:\.|\x20?[(\[{]dot[)\]}]\x20?|\x20dot\x20)"
LOOSE = {
    "spelled": (
        "email",
        rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+{AT}[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]++)++",
        r"{t} RLIKE '(?i)[ (\\[{{]at[ )\\]}}]' AND {t} RLIKE '(?i)[ (\\[{{]at[ )\\]}}].*[.d]'",
        "CAST(NULL AS BOOLEAN)",
        rf"regexp_replace(regexp_replace({{v}}, '(?i){AT}', '@'), '(?i){DOT}', '.')",
    ),
    "handle": ("email", rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]++(?!\.?[A-Za-z0-9-])", "contains({t}, '@')", "false", "{v}"),
    "defanged": (
        "ip",
        r"(?<![0-9])[0-9]++(?:\x20?[(\[{](?:\.|dot)[)\]}]\x20?[0-9]++){3}+",
        r"{t} RLIKE '[0-9] ?[(\\[{{][.d]'",
        "if(forall(split(regexp_replace({v}, '[^0-9]+', '.'), '[.]'), x -> coalesce(try_cast(x AS BIGINT) <= 255, false)), NULL, false)",
        "regexp_replace({v}, '[^0-9]+', '.')",
    ),
    "short": (
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])",
        r"{t} RLIKE '[0-9][0-9 -]{{11}}'",
        f"if(luhn_check({DIGITS}), NULL, false)",
        "{v}",
    ),
    "marked": (
        "card",
        r"(?<![0-9])[0-9]{4}([./_ ])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
        r"{t} RLIKE '[0-9]{{4}}[./_\\u00A0][0-9]{{4}}'",
        f"if(luhn_check({DIGITS}), NULL, false)",
        r"regexp_replace({v}, '[./_\u00A0]', ' ')",
    ),
    "national": (
        "phone",
        r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
        r"{t} RLIKE '[0-9][ .-][0-9]{{3}}'",
        "CAST(NULL AS BOOLEAN)",
        "{v}",
    ),
}
# Words that name a kind, and words that name other numbers; looked for before a proposal.
NAMES = {
    "email": "(?i)e-?mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|addr|host|server|serv",
    "card": "(?i)card|visa|credit|karte|tarjeta|carte",
    "phone": r"(?i)\btel|phone|call|mobil|\bfax|tél",
}
OTHER = r"(?i)version|\bv\.? ?$|order|invoice|\bref|isbn|serial|\bid\b|\bno\."
NORMAL = {kind: "{v}" for kind in KINDS} | {"phone": r"regexp_replace({v}, '^[+][0-9]{{1,3}}[ .-]?(?=.{{6}})', '')"}

# Whole-number features of a proposal x: its normal form `x.f`, its kind, and what stands around it.
ALL_NAMES = "CASE x.kind " + " ".join(f"WHEN {k} THEN x.before RLIKE '{literal(NAMES[kind])}'" for k, kind in enumerate(KINDS)) + " END"
FEATURES = {
    "kind": "x.kind",
    "chars": "least(length(x.f), 44) div 4",
    "digits": "least(length(regexp_replace(x.f, '[^0-9]', '')), 19)",
    "groups": "least(size(filter(split(x.f, '[^0-9]+'), y -> y <> '')), 6)",
    "last": "least(length(regexp_extract(x.f, '([0-9]*)[^0-9]*$', 1)), 9)",
    "letters": "least(length(regexp_replace(x.f, '[^A-Za-z]', '')), 40) div 4",
    "tail": "if(x.kind = 0, least(length(regexp_extract(x.f, '[.]([A-Za-z]*)$', 1)), 8), 0)",
    "distinct": "least(size(array_distinct(split(regexp_replace(x.f, '[^0-9]', ''), ''))), 10)",
    "marks": "least(size(array_distinct(split(regexp_replace(x.f, '[A-Za-z0-9]', ''), ''))), 5)",
    "zero": "CAST(x.f RLIKE '(^|[^0-9])0[0-9]' AS INT)",
    "left": "CASE WHEN x.before = '' OR x.before RLIKE '[\\\\x00-\\\\x20]$' THEN 0 WHEN x.before RLIKE '[A-Za-z0-9]$' THEN 1 ELSE 2 END",
    "right": "CASE WHEN x.after = '' OR x.after RLIKE '^[\\\\x00-\\\\x20]' THEN 0 WHEN x.after RLIKE '^[A-Za-z0-9]' THEN 1 ELSE 2 END",
    "named": f"CAST({ALL_NAMES} AS INT)",
    "other": f"CAST(x.before RLIKE '{literal(OTHER)}' AS INT)",
    "near": "least(length(regexp_replace(x.before, '[^0-9]', '')), 9)",
    "crowd": "least(CAST(log2(1 + size(p)) AS INT), 9)",
}
FEATURES = {name: f"CAST({sql} AS INT)" for name, sql in FEATURES.items()}


def matches(df: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """Add `_<name>`: the leftmost non-overlapping matches of a pattern in `_text` as (start, v, before, after).

    Starts are running totals over the pieces between matches, summed in blocks, so a text with very many matches costs
    little more than its length.
    """
    quoted = literal(pattern)
    when = guard.format(t="_text")
    df = df.withColumns(
        {
            "_m": F.expr(f"CASE WHEN {when} THEN regexp_extract_all(_text, '{quoted}', 0) ELSE CAST(array() AS ARRAY<STRING>) END"),
            "_p": F.expr(f"CASE WHEN {when} THEN split(_text, '{quoted}', -1) ELSE CAST(array() AS ARRAY<STRING>) END"),
        }
    )
    places = f"""
    transform(array(zip_with(_m, _p, (x, y) -> coalesce(length(x), 0) + length(y))), a ->
      transform(array(aggregate(transform(sequence(0, CAST(size(_m) div {BLOCK} AS INT)), k -> aggregate(slice(a, k * {BLOCK} + 1, {BLOCK}), 0, (s, x) -> s + x)),
        array(0), (s, x) -> concat(s, array(element_at(s, -1) + x)))), b ->
        transform(_m, (v, i) -> named_struct(
          'start', b[CAST(i div {BLOCK} AS INT)] + aggregate(slice(a, CAST(i div {BLOCK} AS INT) * {BLOCK} + 1, i % {BLOCK}), 0, (s, x) -> s + x) + length(_p[i]),
          'v', v, 'before', right(_p[i], 24), 'after', left(_p[i + 1], 8)))))[0][0]"""
    none = "CAST(array() AS ARRAY<STRUCT<start: INT, v: STRING, before: STRING, after: STRING>>)"
    return df.withColumn(f"_{name}", F.expr(f"CASE WHEN size(_m) > 0 THEN {places} ELSE {none} END")).drop("_m", "_p")


def proposals(docs: DataFrame) -> DataFrame:
    """Replace `_text` by `base` (kind, start, end; kind as a place in KINDS) and `found`, all proposals with features and a label.

    The label is 1 for a base span, 0 where a check refutes it or a base span of another kind overlaps it, null where it
    is open. A loose proposal that overlaps a base span of its own kind is left out.
    """
    listed = []
    for k, kind in enumerate(KINDS):
        pattern, guard, check = BASE[kind]
        docs = matches(docs, kind, pattern, guard)
        listed.append(struct_of(kind, k, "true", check, NORMAL[kind]))
    for name, (kind, pattern, guard, check, normal) in LOOSE.items():
        docs = matches(docs, name, pattern, guard)
        listed.append(struct_of(name, KINDS.index(kind), "false", check, normal))
    docs = docs.withColumn("_all", F.expr(f"concat({', '.join(listed)})")).drop("_text", *[f"_{n}" for n in (*KINDS, *LOOSE)])
    base = "array_sort(transform(filter(_all, x -> x.fixed AND x.sure), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end)))"
    docs = docs.withColumn("base", F.expr(base))
    overlap = "exists(base, y -> y.start < x.end AND x.start < y.end{more})"
    label = f"CASE WHEN x.sure THEN 1 WHEN NOT x.sure OR {overlap.format(more='')} THEN 0 END"
    keep = f"x.fixed OR NOT {overlap.format(more=' AND y.kind = x.kind')}"
    features = ", ".join(f"'{name}', {sql}" for name, sql in FEATURES.items())
    found = f"transform(array(filter(_all, x -> {keep})), p -> transform(p, x -> named_struct('start', x.start, 'end', x.end, 'label', {label}, {features})))[0]"
    return docs.withColumn("found", F.expr(found)).drop("_all")


def struct_of(name: str, kind: int, fixed: str, check: str, normal: str) -> str:
    v = "x.v"
    return (
        f"transform(_{name}, x -> named_struct('kind', {kind}, 'start', x.start, 'end', x.start + length(x.v), 'before', x.before, 'after', x.after, "
        f"'fixed', {fixed}, 'sure', {check.format(v=v)}, 'f', {literal_format(normal, v)}))"
    )


def literal_format(normal: str, v: str) -> str:
    return normal.replace("{{", "\0").replace("}}", "\1").replace("{v}", v).replace("\0", "{").replace("\1", "}").replace("\\", "\\\\")


# A tree is a number (its value) or (feature, limit, tree at or below, tree above).
Tree = float | tuple


def tree_sql(tree: Tree, prefix: str = "") -> str:
    if isinstance(tree, tuple):
        name, limit, low, high = tree
        return f"IF({prefix}{name} <= {limit}, {tree_sql(low, prefix)}, {tree_sql(high, prefix)})"
    return f"{tree!r}D"


def margin_sql(trees: list[Tree], prefix: str = "") -> str:
    return " + ".join(["0D", *(tree_sql(t, prefix) for t in trees)])


def score_sql(trees: list[Tree], prefix: str = "") -> str:
    return f"(1D / (1D + exp(-({margin_sql(trees, prefix)}))))"


def best_split(cells: dict[str, dict[int, tuple[float, float]]]) -> tuple | None:
    """(feature, limit, sums at or below, sums above) with the largest gain, from sums (gradient, curvature) by feature and value.

    Among limits of equal gain the middle one is taken, halfway between the values that part the examples.
    """
    best, choice = 1e-6, None
    for name, by_value in cells.items():
        values = sorted(by_value)
        whole = [sum(by_value[v][k] for v in values) for k in (0, 1)]
        g = h = 0.0
        for low, high in zip(values, values[1:]):
            g, h = g + by_value[low][0], h + by_value[low][1]
            rest = whole[0] - g, whole[1] - h
            gain = g * g / (h + RIDGE) + rest[0] ** 2 / (rest[1] + RIDGE) - whole[0] ** 2 / (whole[1] + RIDGE)
            if round(gain, 6) > best:
                best, choice = round(gain, 6), (name, (low + high) // 2, (g, h), rest)
    return choice


def boost(examples: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> list[Tree]:
    """Trees fitted to (features, label, w) by Newton boosting; each level is one aggregation over the examples."""
    trees: list[Tree] = []
    for _ in range(rounds):
        p = score_sql(trees)
        graded = examples.selectExpr("*", f"w * (label - {p}) AS g", f"w * {p} * (1D - {p}) AS h")
        leaves: list[tuple] = [()]  # paths of (feature, limit, goes above)
        values: dict[tuple, float] = {}
        splits: dict[tuple, tuple] = {}
        for level in range(depth):
            node = "CASE " + " ".join(f"WHEN {path_sql(path)} THEN {i}" for i, path in enumerate(leaves)) + " END"
            pairs = ", ".join(f"named_struct('name', '{name}', 'v', {name})" for name in FEATURES)
            each = graded.selectExpr(f"{node} AS node", "g", "h", f"inline(array({pairs}))").filter("node IS NOT NULL")
            sums: dict[int, dict] = defaultdict(lambda: defaultdict(dict))
            for r in each.groupBy("node", "name", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
                sums[r.node][r.name][r.v] = (r.g, r.h)
            open_leaves = []
            for i, path in enumerate(leaves):
                cells = {name: sums[i][name] for name in FEATURES if name in sums[i]}
                split = best_split(cells) if cells else None
                if split is None:
                    continue
                name, limit, low, high = split
                splits[path] = (name, limit)
                for above, (g, h) in ((False, low), (True, high)):
                    child = (*path, (name, limit, above))
                    values[child] = RATE * g / (h + RIDGE)
                    open_leaves.append(child)
            leaves = open_leaves
            if not leaves:
                break
        if () not in splits:
            break
        trees.append(assembled((), splits, values))
    return trees


def path_sql(path: tuple) -> str:
    return " AND ".join([f"{name} {'>' if above else '<='} {limit}" for name, limit, above in path]) or "true"


def assembled(path: tuple, splits: dict, values: dict) -> Tree:
    if path not in splits:
        return float(round(values[path], 12))
    name, limit = splits[path]
    return (name, limit, assembled((*path, (name, limit, False)), splits, values), assembled((*path, (name, limit, True)), splits, values))


def thresholds(marked: DataFrame, trees: list[Tree], precision: float) -> dict[int, int]:
    """By kind, the lowest score bin (of BINS, one half at least) at and above which labelled proposals are right at `precision`.

    One wrong proposal is added to each count, so that few examples admit nothing.
    """
    bins = marked.selectExpr("kind", "label", "w", f"CAST(floor({score_sql(trees)} * {BINS}) AS INT) AS bin")
    counted = bins.groupBy("kind", "bin").agg(F.sum(F.expr("w * label")).alias("right"), F.sum(F.expr("w * (1 - label)")).alias("wrong"))
    out: dict[int, int] = {}
    right, wrong = defaultdict(float), defaultdict(float)
    for r in sorted(counted.filter(f"bin >= {BINS // 2}").collect(), key=lambda r: -r.bin):
        right[r.kind] += r.right
        wrong[r.kind] += r.wrong
        if right[r.kind] >= precision * (right[r.kind] + wrong[r.kind] + 1):
            out[r.kind] = r.bin
    return out


def personal_data(df: DataFrame, max_shapes: int = 20_000, precision: float = 0.95, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `base` and `spans`: arrays of (kind, start, end) in code points, end exclusive, by kind (email, ip, card, phone), then start.

    `base` holds what the fixed patterns and their checks confirm; `spans` adds open proposals that the boosted trees
    select and that overlap no base span, of overlapping ones the best score (ties: the earlier, then the longer). Trees
    are fitted on the labelled proposals of documents whose crc32(doc_id as text) mod 5 is not 0, collapsed to distinct
    feature sets, of which at most `max_shapes` with the smallest hashes are used: the only bound. Thresholds come from
    all labelled proposals of the other documents; a kind with too few to show `precision` adds nothing, and neither does
    a corpus without labels of both kinds. A null text counts as empty and has no span; whole texts are read. Every row
    stays, repeated rows too, and a null id counts as the empty text; columns with the added names are replaced; an empty
    table gives an empty one.
    """
    added = ("base", "spans")
    own = [f.name for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + name.replace("`", "``") + "`") for name in own]
    given = lambda name: F.col("`" + name.replace("`", "``") + "`")
    docs = df.select(
        F.struct(F.lit(0).alias("_"), *[c.alias(f"c{i}") for i, c in enumerate(quoted)]).alias("row"),
        (id_remainder(given(doc), 5) == 0).alias("held"),
        F.coalesce(given(text).cast("string"), F.lit("")).alias("_text"),
    )
    stored = cut_lineage(proposals(docs))
    labelled = stored.select("held", F.inline("found")).filter("label IS NOT NULL")
    shapes = cut_lineage(labelled.groupBy("held", "label", *FEATURES).agg(F.count("*").cast("double").alias("w")))
    seen = shapes.filter("NOT held")
    both = {r.label for r in seen.groupBy("label").count().collect()} == {0, 1}
    trees: list[Tree] = []
    if both:
        trees = boost(cut_lineage(seen.orderBy(F.xxhash64("label", *FEATURES), "label", *FEATURES).limit(max_shapes)))
    limits = thresholds(shapes.filter("held"), trees, precision) if trees else {}
    return stored.select(*[F.col(f"row.c{i}").alias(name) for i, name in enumerate(own)], *selected(trees, limits))


def selected(trees: list[Tree], limits: dict[int, int]) -> list:
    """The columns `base` and `spans`."""
    named = "transform(array_sort({0}), x -> named_struct('kind', element_at(array({1}), x.kind + 1), 'start', x.start, 'end', x.end))"
    names = ", ".join(f"'{k}'" for k in KINDS)
    base = F.expr(named.format("base", names)).alias("base")
    if not limits:
        return [base, F.expr(named.format("base", names)).alias("spans")]
    limit = "CASE x.kind " + " ".join(f"WHEN {k} THEN {b}" for k, b in sorted(limits.items())) + f" ELSE {BINS + 1} END"
    passing = f"floor({score_sql(trees, 'x.')} * {BINS}) >= {limit}"
    free = "NOT exists(base, y -> y.start < x.end AND x.start < y.end)"
    some = f"transform(filter(found, x -> x.label IS NULL AND {passing} AND {free}), x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 's', {score_sql(trees, 'x.')}))"
    worse = "y.start < x.end AND x.start < y.end AND struct(y.s, -y.start, y.end, -y.kind) > struct(x.s, -x.start, x.end, -x.kind)"
    best = f"transform(array({some}), a -> filter(a, x -> NOT exists(a, y -> {worse})))[0]"
    extra = f"transform({best}, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))"
    return [base, F.expr(named.format(f"concat(base, {extra})", names)).alias("spans")]
