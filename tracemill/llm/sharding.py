"""Sharding by a hierarchical weighted hash tree.

A document goes down the tree level by level - region, rack, shard.  At each
node every child draws a number from a hash of the document's key and the
child's name, ln(u) / -weight with u uniform in (0, 1); the least draw wins.  A
child is chosen in proportion to its weight, and as a child's draw depends on
nothing but the key, its name and its weight, a changed weight moves documents
only to or from that child: movement stays inside the subtrees whose weights
change.  A parent's weight is the sum of its children's.

Everything is one projection of built-in functions over the key column: no
shuffle, no Python, no state.  A level is one expression over a constant map
from each node to its children, so the plan has the same size for any number of
shards.  Ties go to the child that is named first.

Defined cases: a null key gets null nodes; keys may be of any type, those that
repeat get the same shard; a table that has a column of a level's name already
keeps it, and the level's column gets an underscore behind its name; children of weight 0 or less get nothing, and a tree in which no child has
weight is an error; an empty table gives no rows; text is not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.columns import fresh, quoted

LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Node:
    name: str
    weight: float = 0.0
    children: tuple["Node", ...] = field(default=())

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else max(0.0, self.weight)


def tree(spec: dict) -> Node:
    """A tree from nested dicts whose leaves are weights."""

    def build(name: str, x: dict | float) -> Node:
        if isinstance(x, dict):
            return Node(name, children=tuple(build(f"{name}/{k}" if name else k, v) for k, v in x.items()))
        return Node(name, float(x))

    return build("", spec)


#: Shards of unlike size in racks and regions of unlike number.
PRODUCTION = tree({
    "eu": {"r1": {"s1": 4, "s2": 4, "s3": 2}, "r2": {"s1": 4, "s2": 4}},
    "us": {"r1": {"s1": 8, "s2": 8}, "r2": {"s1": 8, "s2": 4, "s3": 4}, "r3": {"s1": 4, "s2": 4}},
    "ap": {"r1": {"s1": 2, "s2": 2}, "r2": {"s1": 4}},
})

#: 13 hexadecimal digits of the hash: below 2 ** 52, exact as a double.
_SPACE = float(1 << 52)


def draw(key: Column, name: Column, weight: Column) -> Column:
    """The draw for the key of the node of a name: exponential, of rate its weight."""
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit("|"), name)), 1, 13), 16, 10).cast("double")
    return -F.log((h + 0.5) / F.lit(_SPACE)) / weight


def _able(node: Node) -> Column:
    """The children that have weight, as an array."""
    able = [c for c in node.children if c.total > 0]
    if not able:
        raise ValueError(f"no child of {node.name or 'the root'} has weight")
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(c.name).alias("name"), F.lit(float(c.total)).alias("weight")) for i, c in enumerate(able)])


def _choose(key: Column, children: Column) -> Column:
    """The name of the child that the key goes to; null without children."""
    # A struct is compared field by field: the draw, then the place among the children.
    return F.array_min(F.transform(children, lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("d"), c["i"].alias("i"), c["name"].alias("name"))))["name"]


def assign(df: DataFrame, key: str = "doc_id", root: Node = PRODUCTION, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """df with a column for each level: the full name of the node that the key goes to."""
    k, names, nodes, above, out = quoted(key), fresh(df, *levels), [root], None, df
    for name in names:
        children = _able(root)
        if above is not None:
            children = F.element_at(F.create_map(*[x for n in nodes if n.total > 0 for x in (F.lit(n.name), _able(n))]), above)
        out = out.withColumn(name, F.when(k.isNotNull(), _choose(k, children)))
        nodes, above = [c for n in nodes for c in n.children], quoted(name)
    return out


def moves(df: DataFrame, before: Node, after: Node, key: str = "doc_id", levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """key, from, to: the keys whose shard two trees give differently."""
    one = df.select(quoted(key).alias("key"))
    old = assign(one, "key", before, levels).select("key", quoted(levels[-1]).alias("from"))
    new = assign(old, "key", after, levels).filter(quoted(levels[-1]) != F.col("from"))
    return new.select(F.col("key").alias(key), "from", quoted(levels[-1]).alias("to"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs.select("doc_id"))


def sql(root: Node = PRODUCTION, levels: tuple[str, ...] = LEVELS, table: str = "documents", key: str = "doc_id") -> str:
    """The same assignment in DuckDB's SQL."""

    def choose(node: Node) -> str:
        able = [c for c in node.children if c.total > 0]
        if len(able) == 1:
            return f"'{able[0].name}'"
        h = [f"-ln((('0x' || substr(md5({key} || '|{c.name}'), 1, 13))::BIGINT::DOUBLE + 0.5) / {_SPACE!r}) / {c.total!r}" for c in able]
        names = ", ".join(f"'{c.name}'" for c in able)
        return f"list_extract([{names}], list_position([{', '.join(h)}], least({', '.join(h)})))"

    nodes, query = [root], f"SELECT {key} FROM {table}"
    for i, level in enumerate(levels):
        if i == 0:
            pick = f"CASE WHEN {key} IS NOT NULL THEN {choose(root)} END"
        else:
            pick = "CASE " + " ".join(f"WHEN {levels[i - 1]} = '{n.name}' THEN {choose(n)}" for n in nodes if n.total > 0) + " END"
        query = f"SELECT *, {pick} AS {level} FROM ({query})"
        nodes = [c for n in nodes for c in n.children]
    return query
