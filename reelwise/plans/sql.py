"""Named SQL fragments for the reference answers, combined into one WITH query on demand."""

from __future__ import annotations

from reelwise.plans.world import NUDGE

FRAGMENTS: dict[str, tuple[list[str], str]] = {}


def fragment(name: str, needs: list[str], sql: str) -> None:
    FRAGMENTS[name] = (needs, sql.strip())


def query(needs: list[str], select: str, extra: dict[str, str] | None = None) -> str:
    """WITH every needed fragment, dependencies first, then `select`."""
    ordered: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in ordered:
            return
        deps, sql = FRAGMENTS[name]
        for dep in deps:
            visit(dep)
        ordered[name] = sql

    for name in needs:
        visit(name)
    ordered.update({k: v.strip() for k, v in (extra or {}).items()})
    parts = ",\n".join(f"{name} AS MATERIALIZED (\n{sql}\n)" for name, sql in ordered.items())
    return f"WITH {parts}\n{select.strip()}" if parts else select.strip()


def rx(expression: str, name: str) -> str:
    """`expression` rounded exactly as `world.rounded` does."""
    return f"round(CAST({expression} AS DOUBLE) + {NUDGE}, 6) + 0.0 AS {name}"


def r6(*names: str) -> str:
    return ", ".join(rx(name, name.split(".")[-1]) for name in names)


def hash32(seed: int | str, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT)"


def unit_hash(seed: int | str, *parts: str) -> str:
    return f"(({hash32(seed, *parts)} + 0.5) / 4294967296.0::DOUBLE)"


LABELS = """
  CASE WHEN watch_ratio >= 1 THEN 1 ELSE 0 END AS label_complete,
  CASE WHEN watch_ratio >= 2 THEN 1 ELSE 0 END AS label_strong,
  CASE WHEN play_duration < least(3000, video_duration) THEN 1 ELSE 0 END AS label_short
"""

fragment(
    "log",
    [],
    f"""
SELECT r.*, {LABELS},
  CASE WHEN date <= 20240120 THEN 'train' WHEN date <= 20240125 THEN 'valid' ELSE 'test' END AS split
FROM (
  SELECT e.event_id, e.user_id, CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS item_id,
    CAST(strftime(e.ts, '%Y%m%d') AS INTEGER) AS date, e.ts AS timestamp,
    e.value / 50 AS watch_ratio, 100 * e.value AS play_duration, 200 * p.p_size AS video_duration
  FROM events e LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
) r
""",
)


def orders_fragment(name: str, train_end: int, valid_end: int) -> None:
    fragment(
        name,
        [],
        f"""
SELECT r.*, {LABELS},
  CASE WHEN date <= {train_end} THEN 'train' WHEN date <= {valid_end} THEN 'valid' ELSE 'test' END AS split
FROM (
  SELECT q.item_id AS event_id, q.user_id, q.item_id, q.date, q.date AS timestamp,
    q.q / 20 AS watch_ratio, 100 * q.q AS play_duration, 200 * p.p_size AS video_duration
  FROM (
    SELECT o.o_custkey AS user_id, l.l_partkey AS item_id,
      CAST(strftime(l.l_shipdate, '%Y%m%d') AS INTEGER) AS date, max(l.l_quantity) AS q
    FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL
  ) q LEFT JOIN part p ON p.p_partkey = q.item_id
) r
""",
    )


orders_fragment("olog", 19991231, 20001231)
orders_fragment("elog", 19950630, 19951231)


def items_fragment(name: str, log: str, opened: str) -> None:
    fragment(
        name,
        [log],
        f"""
SELECT p_partkey AS item_id, CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) AS first_category,
  CAST(p_size AS BIGINT) AS author_id, CAST(200 * p_size AS DOUBLE) AS video_duration,
  p_name || ' ' || p_type AS content_text, coalesce(f.d, {opened}) AS first_seen_date
FROM part LEFT JOIN (SELECT item_id, min(date) AS d FROM {log} GROUP BY 1) f ON f.item_id = p_partkey
""",
    )


items_fragment("items", "log", "20240101")
items_fragment("eitems", "elog", "NULL")
items_fragment("oitems", "olog", "NULL")
for prefix in ("", "o", "e"):
    fragment(f"{prefix}train", [f"{prefix}log"], f"SELECT * FROM {prefix}log WHERE split = 'train'")
    fragment(f"{prefix}seen", [f"{prefix}train"], f"SELECT DISTINCT user_id, item_id FROM {prefix}train")
    fragment(
        f"{prefix}truth",
        [f"{prefix}log", f"{prefix}seen"],
        f"""
SELECT DISTINCT t.user_id, t.date, t.item_id FROM {prefix}log t
ANTI JOIN {prefix}seen s ON s.user_id = t.user_id AND s.item_id = t.item_id
WHERE t.split = 'test' AND t.label_complete = 1
""",
    )
    fragment(f"{prefix}users", [f"{prefix}log"], f"SELECT DISTINCT user_id FROM {prefix}log")
