"""Sharding by a hierarchical weighted hash tree.

A key descends from the root by region, rack and shard. At each level every child draws -ln(u)/weight from a hash
of the key and the child's path, and the least draw wins, so children get keys in proportion to their weights. A
draw depends on nothing but the key and that child: when a weight changes, keys move only to or from that child,
and below a node whose own subtree is unchanged nothing moves at all.

Placement is a narrow projection inside the scan's stage. What is hashed is the key, never the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.runtime import free_name

Tree = dict[str, tuple[float, "Tree | None"]]
LEVELS = ("region", "rack", "shard")

#: name -> (weight, children); children of the last level are None.
TREE: Tree = {
    "east": (3.0, {"e1": (2.0, {"e1a": (1.0, None), "e1b": (1.0, None)}), "e2": (1.0, {"e2a": (1.0, None), "e2b": (2.0, None)})}),
    "north": (2.0, {"n1": (1.0, {"n1a": (1.0, None), "n1b": (1.0, None), "n1c": (2.0, None)})}),
    "west": (1.0, {"w1": (1.0, {"w1a": (1.0, None)}), "w2": (3.0, {"w2a": (1.0, None), "w2b": (0.5, None)})}),
}


def checked(tree: Tree, depth: int = len(LEVELS), above: str = "") -> None:
    """Raises ValueError unless all leaves lie at ``depth`` and every node has a child of positive weight."""
    if not depth:
        if tree is not None:
            raise ValueError(f"{above} lies too deep")
        return
    if not tree or not any(w > 0 for w, _ in tree.values()) or any(w < 0 for w, _ in tree.values()):
        raise ValueError(f"no child of positive weight under {above or 'the root'}")
    for name, (_, below) in tree.items():
        checked(below, depth - 1, f"{above}/{name}")


def _draw(key: Column, path: str, weight: float) -> Column:
    u = F.conv(F.substring(F.md5(F.concat(key, F.lit("|" + path))), 1, 13), 16, 10).cast("double")
    return -F.log((u + 0.5) / float(2**52)) / F.lit(weight)


def _chosen(key: Column, tree: Tree, path: str, depth: int) -> Column:
    """Array of the names from this level down; only the draws of the nodes on a key's way are made."""
    live = [(name, w, below) for name, (w, below) in sorted(tree.items()) if w > 0]
    if len(live) == 1:
        return _below(key, live[0][0], live[0][2], path, depth)
    best = F.array_min(F.array(*(F.struct(_draw(key, f"{path}/{name}", w).alias("d"), F.lit(name).alias("name")) for name, w, _ in live)))["name"]
    out = None
    for name, _, below in live:
        own = _below(key, name, below, path, depth)
        out = F.when(best == name, own) if out is None else out.when(best == name, own)
    return out


def _below(key: Column, name: str, below: Tree | None, path: str, depth: int) -> Column:
    here = F.array(F.lit(name))
    return here if depth == 1 else F.concat(here, _chosen(key, below, f"{path}/{name}", depth - 1))


def placed(docs: DataFrame, tree: Tree = TREE, id_col: str = "doc_id", names: tuple[str, str, str] = LEVELS) -> DataFrame:
    """``docs`` with region, rack and shard of every row (columns of these names are replaced).

    Rows with the same id go to the same shard, repeated rows too; of equal draws the first child by name wins. Null ids share one place, that of the key "null".
    Texts aren't read, so they may be null, empty or long. An empty table gives an empty table. Weights of zero get no
    keys; a tree without leaves at the third level, or with negative weights, is a ValueError.
    """
    checked(tree)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    at = free_name(docs, "place")
    keep = [c for c in docs.columns if c.lower() not in {n.lower() for n in names}]
    return docs.withColumn(at, _chosen(key, tree, "", 3)).select(*keep, *(F.element_at(at, i + 1).alias(n) for i, n in enumerate(names)))


def write_shards(docs: DataFrame, path: str, tree: Tree = TREE, id_col: str = "doc_id", files: int = 1, names: tuple[str, str, str] = LEVELS) -> None:
    """Writes ``placed`` rows as Parquet folders region/rack/shard, about ``files`` files in each; one shuffle, in which a
    shard's rows are spread over ``files`` tasks by their ids.

    Cases as for :func:`placed`: null ids go to one place, repeated rows are written each, texts of any length or null are passed on, columns
    named like the levels are replaced. An empty table gives a folder without shards. What ``path`` held before is replaced.
    """
    spread = F.pmod(F.xxhash64(F.col(id_col)), F.lit(files))
    placed(docs, tree, id_col, names).repartition(*names, spread).write.mode("overwrite").partitionBy(*names).parquet(path)


def oracle(tree: Tree = TREE) -> str:
    """DuckDB SQL of :func:`placed` on ``documents``, by id."""
    nodes: list[tuple[int, str, str, float]] = []

    def walk(t: Tree, path: str, depth: int) -> None:
        for name, (w, below) in t.items():
            if w > 0:
                nodes.append((depth, path, name, w))
                if below:
                    walk(below, f"{path}/{name}", depth + 1)

    walk(tree, "", 1)
    values = ", ".join(f"({d}, '{p}', '{n}', {w!r}::DOUBLE)" for d, p, n, w in nodes)
    draw = "-ln((('0x' || substr(md5(k.id || '|' || n.above || '/' || n.name), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) / n.weight"
    steps, before = [], "SELECT DISTINCT coalesce(doc_id::VARCHAR, 'null') AS id, '' AS above FROM documents"
    for i, level in enumerate(LEVELS):
        carried = "".join(f", any_value(k.{x}) AS {x}" for x in LEVELS[:i])
        steps.append(f"k{i} AS ({before}), c{i} AS (SELECT k.id, any_value(k.above) AS above{carried}, arg_min(n.name, struct_pack(d := {draw}, name := n.name)) AS {level} FROM k{i} k JOIN node n ON n.depth = {i + 1} AND n.above = k.above GROUP BY k.id)")
        before = f"SELECT id, above || '/' || {level} AS above{''.join(f', {x}' for x in LEVELS[: i + 1])} FROM c{i}"
    return f"""
WITH node(depth, above, name, weight) AS (VALUES {values}), {', '.join(steps)}
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.region, c.rack, c.shard
FROM documents d JOIN c2 c ON c.id = coalesce(d.doc_id::VARCHAR, 'null')
"""
