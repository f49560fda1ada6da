"""Sample graphs, built in place."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.graph import PropertyGraph

# The sample graph of gods that graph databases are commonly introduced with.
TITANS = [("saturn", 10000)]
LOCATIONS = ["sky", "sea", "tartarus"]
GODS = [("jupiter", 5000), ("neptune", 4500), ("pluto", 4000)]
DEMIGODS = [("hercules", 30)]
HUMANS = [("alcmene", 45)]
MONSTERS = ["nemean", "hydra", "cerberus"]
FATHER = [("jupiter", "saturn"), ("hercules", "jupiter")]
MOTHER = [("hercules", "alcmene")]
LIVES = [("jupiter", "sky", "loves fresh breezes"), ("neptune", "sea", "loves waves"), ("pluto", "tartarus", "no fear of death"), ("cerberus", "tartarus", None)]
BROTHER = [("jupiter", "neptune"), ("jupiter", "pluto"), ("neptune", "jupiter"), ("neptune", "pluto"), ("pluto", "jupiter"), ("pluto", "neptune")]
BATTLED = [("hercules", "nemean", 1, 38.1, 23.7), ("hercules", "hydra", 2, 37.7, 23.9), ("hercules", "cerberus", 12, 39.0, 22.0)]
PET = [("pluto", "cerberus")]


def gods(spark: SparkSession) -> PropertyGraph:
    """12 vertices, 17 edges."""
    g = PropertyGraph(spark)
    groups = {"titan": TITANS, "location": [(x, None) for x in LOCATIONS], "god": GODS, "demigod": DEMIGODS, "human": HUMANS, "monster": [(x, None) for x in MONSTERS]}
    kinds = {}
    for label, rows in groups.items():
        g.add_vertices(label, spark.createDataFrame(rows, "name string, age int"), "name", string_key=True)
        kinds |= {n: label for n, _ in rows}

    def edges(label: str, rows: list[tuple], columns: str, props: list) -> None:
        by_ends: dict = {}
        for r in rows:
            by_ends.setdefault((kinds[r[0]], kinds[r[1]]), []).append(r)
        for (a, b), rs in by_ends.items():
            df = spark.createDataFrame(rs, columns)
            eid = F.concat_ws(">", "o", F.lit(label), "i")
            g.add_edges(label, df, a, F.col("o"), b, F.col("i"), eid, True, True)
            table = g.edges[label][-1]
            table.df = table.df.select("eid", "src", "dst", *props)

    edges("father", FATHER, "o string, i string", [])
    edges("mother", MOTHER, "o string, i string", [])
    edges("brother", BROTHER, "o string, i string", [])
    edges("pet", PET, "o string, i string", [])
    edges("lives", LIVES, "o string, i string, reason string", ["reason"])
    edges("battled", BATTLED, "o string, i string, time int, lat double, lon double", ["time", F.struct("lat", "lon").alias("place")])
    return g
