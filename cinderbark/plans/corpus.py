"""Planted corpora: Python projects rendered from table rows by column expressions.

Which code in them is dead follows from the columns, so SQL over the same tables
can say what a scan has to find without seeing any source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Files of a corpus that one task renders and parses.
FILES = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows``, each of which becomes a file, in tasks of some ``FILES``: a few MB of them are many files to parse."""
    return rows.repartition(rows.count() // FILES + 1, key)


def lines(*parts) -> Column:
    """Source text; null parts leave no line."""
    return F.concat(F.concat_ws("\n", *(p if isinstance(p, Column) else F.lit(p) for p in parts)), F.lit("\n"))


def text(pattern: str, *values) -> Column:
    return F.format_string(pattern, *values)


def files(rows: DataFrame, project: Column | str, path: Column | str, source: Column) -> DataFrame:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select(as_column(project).alias("project_id"), as_column(path).alias("path"), source.alias("source"))


def one(spark: SparkSession) -> DataFrame:
    return spark.range(1)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per part: an import that even sizes use, dead code for large sizes, an unread local for high prices,
    and a body of five statements that is the same for all parts of a brand."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    even, large, dear = F.col("p_size") % 2 == 0, F.col("p_size") > 25, F.col("p_retailprice") > 950
    source = lines(
        "import json",
        text("def work_%d(a):", "p_partkey"),
        F.when(even, "    a = json.dumps(a)"),
        F.when(dear, "    left_over = 1"),
        "    return a",
        F.when(large, '    print("never")'),
        text("def same_%d(x):", "p_partkey"),
        text('    brand = "%s"', "p_brand"),
        "    y = x + 1",
        "    z = y * 2",
        "    print(brand, y, z)",
        "    return z",
        'if __name__ == "__main__":',
        text("    work_%d(1)", "p_partkey"),
        text("    same_%d(2)", "p_partkey"),
    )
    return files(p, "parts", text("parts/p_%06d.py", "p_partkey"), source)


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions import their nations, nations their suppliers with money; a main file imports the first three regions."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    r = region.join(nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("below")), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    n = nation.join(supplier.filter("s_acctbal > 0").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("below")), F.col("n_nationkey") == F.col("s_nationkey"), "left")
    imports = lambda kind: F.array_join(F.transform(F.coalesce("below", F.array().cast("array<bigint>")), lambda k: F.concat(F.lit(f"import {kind}_"), k.cast("string"))), "\n")
    chosen = region.filter("r_regionkey < 3").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import region_"), F.col("r_regionkey").cast("string")))), "\n").alias("text"))
    return (
        files(chosen, "supply", "main.py", F.concat("text", F.lit('\nif __name__ == "__main__":\n    print(1)\n')))
        .unionByName(files(r, "supply", text("region_%d.py", "r_regionkey"), F.concat(imports("nation"), F.lit("\n"))))
        .unionByName(files(n, "supply", text("nation_%d.py", "n_nationkey"), F.concat(imports("supplier"), F.lit("\n"))))
        .unionByName(files(supplier, "supply", text("supplier_%d.py", "s_suppkey"), F.lit("STOCK = 1\n")))
    )


def orders(spark: SparkSession, sf_dir: str, customers: int = 40) -> DataFrame:
    """A module per customer group with a function per order: F runs, O is called by code that never runs, P is never named."""
    o = table(spark, sf_dir, "orders").withColumn("g", (F.col("o_custkey") % customers).cast("int"))
    body = F.when(F.col("o_orderstatus") == "O", text("def call_%d():\n    return order_%d()\ndef order_%d():\n    return %d", "o_orderkey", "o_orderkey", "o_orderkey", "o_orderkey")).otherwise(text("def order_%d():\n    return %d", "o_orderkey", "o_orderkey"))
    run = F.when(F.col("o_orderstatus") == "F", text("    shop_%d.order_%d()", "g", "o_orderkey"))
    grouped = o.groupBy("g").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", body.alias("b")))), lambda x: x["b"]), "\n").alias("source"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", run.alias("b")))), lambda x: x["b"]), "\n").alias("calls"),
    )
    main = grouped.agg(F.array_sort(F.collect_list(F.struct("g", "calls"))).alias("all")).select(
        F.concat(
            F.array_join(F.transform("all", lambda x: F.concat(F.lit("import shop_"), x["g"].cast("string"))), "\n"),
            F.lit('\nif __name__ == "__main__":\n    pass\n'),
            F.array_join(F.filter(F.transform("all", lambda x: x["calls"]), lambda c: c != ""), "\n"),
            F.lit("\n"),
        ).alias("source")
    )
    # the longest file first, so that it isn't the last to be read
    return files(main, "orders", "main.py", F.col("source")).unionByName(files(grouped, "orders", text("shop_%d.py", "g"), F.concat("source", F.lit("\n"))))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class per nation below its region's class, a method per supplier; a main file calls those of suppliers with money."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    method = text("    def serve_%d(self):\n        return %d", "s_suppkey", "s_suppkey")
    call = F.when(F.col("s_acctbal") > 0, text("    n_%d.serve_%d()", "s_nationkey", "s_suppkey"))
    s = supplier.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(method)), "\n").alias("methods"), F.array_join(F.array_sort(F.collect_list(call)), "\n").alias("calls"))
    n = nation.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    module = files(
        n, "classes", text("nation_%d.py", "n_nationkey"),
        F.concat(text("from regions import Region%d\nclass Nation%d(Region%d):\n    code_%d = 1\n", "n_regionkey", "n_nationkey", "n_regionkey", "n_nationkey"), F.coalesce("methods", F.lit("    pass")), F.lit("\n")),
    )
    regions = table(spark, sf_dir, "region").agg(F.array_join(F.array_sort(F.collect_list(text("class Region%d:\n    def shared_%d(self):\n        return 1\n    def unused_%d(self):\n        return 2", "r_regionkey", "r_regionkey", "r_regionkey"))), "\n").alias("t"))
    head = n.agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_regionkey", "calls"))).alias("all")).select(
        F.concat(
            F.array_join(F.transform("all", lambda x: F.concat(F.lit("from nation_"), x["n_nationkey"].cast("string"), F.lit(" import Nation"), x["n_nationkey"].cast("string"))), "\n"),
            F.lit('\nif __name__ == "__main__":\n'),
            F.array_join(F.transform("all", lambda x: F.concat(F.lit("    n_"), x["n_nationkey"].cast("string"), F.lit(" = Nation"), x["n_nationkey"].cast("string"), F.lit("()\n    n_"), x["n_nationkey"].cast("string"), F.lit(".shared_"), x["n_regionkey"].cast("string"), F.lit("()"))), "\n"),
            F.lit("\n"),
            F.array_join(F.filter(F.transform("all", lambda x: x["calls"]), lambda c: c != ""), "\n"),
            F.lit("\n"),
        ).alias("source")
    )
    return module.unionByName(files(regions, "classes", "regions.py", F.concat("t", F.lit("\n")))).unionByName(files(head, "classes", "main.py", F.col("source")))


def suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A script per part with an unused import: its comment covers the rule, another rule, or there is none."""
    p = dealt(table(spark, sf_dir, "part"), "p_partkey")
    mark = F.when(F.col("p_size") % 3 == 0, "  # cinderbark: ignore[unused-import] -- kept").when(F.col("p_size") % 3 == 1, "  # cinderbark: ignore[unused-class]").otherwise("")
    source = lines(F.concat(F.lit("import json"), mark), 'if __name__ == "__main__":', "    print(1)")
    return files(p, "suppress", text("tools_%06d.py", "p_partkey"), source)


def manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, manifests, distributions): a requirement per brand; brands ending in an odd digit are imported, and the
    environment knows those that end in 1 to 4."""
    b = table(spark, sf_dir, "part").select(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "").alias("name")).distinct()
    last = F.substring("name", -1, 1).cast("int")
    used = b.filter(last % 2 == 1).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import "), F.col("name")))), "\n").alias("t"))
    wanted = b.agg(F.array_join(F.array_sort(F.collect_list("name")), "\n").alias("t"))
    known = b.filter(last <= 4).select(F.col("name").alias("top"), F.col("name").alias("dist"), F.lit(None).cast("string").alias("file"))
    return (
        files(used, "manifest", "main.py", F.concat("t", F.lit('\nif __name__ == "__main__":\n    print(1)\n'))),
        files(wanted, "manifest", "requirements.txt", F.concat("t", F.lit("\n"))),
        known,
    )
