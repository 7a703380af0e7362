"""The relations of the document domain as views over the supplied tables.

Every view is a projection of its base table, so filters and column lists reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION_TYPES = {"view": "auto", "error": "auto", "click": "manual", "signup": "restore", "purchase": "delete-backup"}
STATUSES = ("pending", "accepted", "rejected")


class Tables:
    """The base tables of one folder, and the relations on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def users(self) -> DataFrame:
        email = F.concat(F.lower(F.trim("c_name")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example"))
        return self.base("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), email.alias("email"))

    def maps(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("owner_id"),
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderdate").alias("updated_at"),
            F.concat(F.lit("y"), F.col("o_orderkey").cast("string")).alias("ydoc_id"),
        )

    def collaborators(self) -> DataFrame:
        """One row per (map, user); an editor where any of its lines is open."""
        editor = F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)) == 1
        grouped = self.base("lineitem").groupBy(F.col("l_orderkey").alias("map_id"), F.col("l_suppkey").alias("user_id"))
        return grouped.agg(F.when(editor, "editor").otherwise("viewer").alias("role"))

    def _events(self) -> DataFrame:
        return self.base("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    def versions(self) -> DataFrame:
        kind = F.create_map(*(F.lit(x) for pair in VERSION_TYPES.items() for x in pair))[F.col("event_type")]
        return self._events().select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("map_id"),
            F.col("k").alias("user_id"),
            F.col("ts").alias("created_at"),
            kind.alias("type"),
            F.floor(F.col("value") * 10000).cast("long").alias("size"),
        )

    def notifications(self) -> DataFrame:
        status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("k") % 3 + 1).cast("int"))
        return self._events().select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("to_user"),
            F.col("k").alias("from_user"),
            (F.col("event_id") % 150).alias("map_id"),
            F.col("ts").alias("created_at"),
            (F.col("k") % 3 == 0).alias("read"),
            status.alias("status"),
        )

    def nodes(self) -> DataFrame:
        """Trees of many documents, each with its own "root-node"; some nodes are not aligned.

        Document 0 has regions, nations and customers; every customer's document has its orders by priority and status.
        """
        empty = F.lit(None).cast("string")
        text = lambda c: F.col(c).cast("string")

        def rows(df: DataFrame, doc, key, above, label, ord_, aligned) -> DataFrame:
            return df.select(doc.cast("long").alias("doc_id"), key.alias("id"), above.alias("parent_id"), label.alias("label"), ord_.cast("long").alias("ord"), aligned.alias("auto_align"))

        yes, zero, root = F.lit(True), F.lit(0), F.lit("root-node")
        customers = self.base("customer")
        own = F.col("o_custkey") + 1
        group = F.concat(F.lit("p"), "o_orderpriority")
        status = F.concat(F.lit("s"), "o_orderpriority", F.lit("/"), "o_orderstatus")
        groups = self.base("orders").select("o_custkey", "o_orderpriority").distinct()
        statuses = self.base("orders").select("o_custkey", "o_orderpriority", "o_orderstatus").distinct()
        parts = [
            rows(self.spark.range(1), zero, root, empty, F.lit("Central Idea"), zero, yes),
            rows(self.base("region"), zero, F.concat(F.lit("r"), text("r_regionkey")), root, F.col("r_name"), F.col("r_regionkey"), yes),
            rows(self.base("nation"), zero, F.concat(F.lit("n"), text("n_nationkey")), F.concat(F.lit("r"), text("n_regionkey")), F.col("n_name"), F.col("n_nationkey"), yes),
            rows(customers, zero, F.concat(F.lit("c"), text("c_custkey")), F.concat(F.lit("n"), text("c_nationkey")), F.col("c_name"), F.col("c_custkey"), F.col("c_custkey") % 17 != 0),
            rows(customers, F.col("c_custkey") + 1, root, empty, F.col("c_name"), zero, yes),
            rows(groups, own, group, root, F.col("o_orderpriority"), zero, yes),
            rows(statuses, own, status, group, F.col("o_orderstatus"), zero, yes),
            rows(self.base("orders"), own, F.concat(F.lit("o"), text("o_orderkey")), status, F.concat(F.lit("order "), text("o_orderkey")), F.col("o_orderkey"), F.col("o_orderkey") % 11 != 0),
        ]
        first, *rest = parts
        for part in rest:
            first = first.unionByName(part)
        return first

    def edges(self) -> DataFrame:
        """Parent-child edges of the trees, and customer-supplier pairs as custom edges of document 0."""
        tree = tree_edges(self.nodes())
        pairs = self.base("lineitem").join(self.base("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_suppkey").distinct()
        source, target = F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
        custom = pairs.select(F.lit(0).cast("long").alias("doc_id"), F.concat(F.lit("custom-"), source, F.lit("-"), target).alias("id"), source.alias("source"), target.alias("target"), F.lit(None).cast("string").alias("color"), F.lit(False).alias("is_parent_child"))
        return tree.unionByName(custom)

    def branches_to_move(self) -> DataFrame:
        return branches_to_move(self.nodes())

    def moves_log(self) -> DataFrame:
        """(doc_id, seq, id, new_parent): with every order, its priority or status moves below the next order's status, or a root."""
        own = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        group = F.concat(F.lit("p"), "o_orderpriority")
        status = F.concat(F.lit("s"), "o_orderpriority", F.lit("/"), "o_orderstatus")
        rows = self.base("orders").select((F.col("o_custkey") + 1).cast("long").alias("doc_id"), F.col("o_orderkey").cast("long").alias("seq"), group.alias("group"), status.alias("status"), F.lead(status).over(own).alias("next"))
        kind = F.col("seq") % 7
        moved = rows.select("doc_id", "seq", F.when(kind < 4, F.col("group")).otherwise(F.col("status")).alias("id"), F.when(kind == 6, "root-node").otherwise(F.col("next")).alias("new_parent"))
        return moved.where("new_parent IS NOT NULL")

    def op_log(self) -> DataFrame:
        return self.base("conversations").select(
            F.col("conv_id").alias("doc_id"), F.col("turn").alias("clock"), F.col("role").alias("client"), F.col("role").alias("key"), F.col("text").alias("value")
        )

    def undo_log(self) -> DataFrame:
        """Edits, undos and redos of the clients of twenty documents."""
        kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("edit")
        return self._events().select(
            (F.col("user_id") % 20).alias("doc_id"),
            F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"),
            F.col("event_id").alias("seq"),
            "ts",
            kind.alias("kind"),
            (F.col("k") % 10).cast("string").alias("key"),
            F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"),
        )

    def list_log(self) -> DataFrame:
        """Insertions into and deletions from the lists of twenty documents, three clients at a time, each behind an element of an earlier time."""
        number, back = F.floor(F.col("event_id") / 20), (F.col("k") % 4 + 1) * 3
        named = lambda n: F.concat(F.lit("e"), n.cast("string"))
        told = self._events().select((F.col("event_id") % 20).alias("doc_id"), "event_id", F.floor(number / 3).alias("clock"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client"), number.alias("n"), back.alias("back"), "k", "event_type")
        inserts = told.select("doc_id", F.lit("insert").alias("kind"), named(F.col("event_id")).alias("id"), F.when(F.col("n") >= F.col("back"), named(F.col("event_id") - 20 * F.col("back"))).alias("after"), "clock", "client", F.concat_ws(" ", "event_type", F.col("event_id").cast("string")).alias("value"))
        none = F.lit(None).cast("string")
        deletes = told.where("event_type = 'error'").select("doc_id", F.lit("delete").alias("kind"), named(F.col("event_id") - 20 * (F.col("k") % 7 + 1)).alias("id"), none.alias("after"), "clock", "client", none.alias("value"))
        return inserts.unionByName(deletes)

    def snapshots(self) -> DataFrame:
        return self.base("documents").select("doc_id", F.col("text").alias("state"), "n_chars")

    def presence(self) -> DataFrame:
        return self._events().groupBy(F.col("user_id").alias("client_id")).agg(F.max("ts").alias("last_updated"))

    def points(self) -> DataFrame:
        return self.base("part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 10.0).alias("x"), (F.col("p_retailprice") / 10).alias("y"))


def tree_edges(nodes: DataFrame) -> DataFrame:
    """The parent-child edges of the trees."""
    return nodes.where("parent_id IS NOT NULL").select(
        "doc_id",
        F.concat(F.lit("e-"), "parent_id", F.lit("-"), "id").alias("id"),
        F.col("parent_id").alias("source"),
        F.col("id").alias("target"),
        F.lit("#3b82f6").alias("color"),
        F.lit(True).alias("is_parent_child"),
    )


def branches_to_move(nodes: DataFrame) -> DataFrame:
    """(doc_id, id, new_parent): the first branch of every document with several, below its last one."""
    branches = nodes.where("parent_id = 'root-node'").groupBy("doc_id")
    place = F.struct("ord", "id")
    found = branches.agg(F.min(place)["id"].alias("id"), F.max(place)["id"].alias("new_parent"))
    return found.where("id <> new_parent")
