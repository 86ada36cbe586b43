"""Small copies of the test tables: empty ones, and ones with a row of nulls, repeated rows and clashing columns."""

from pathlib import Path

from pyspark.sql import functions as F

SMALL = Path("/root/testdata/sf0.001")
TABLES = ["interactions", "questions", "source_citations", "evidence", "sections", "prerequisite_links", "concepts", "documents", "eval_items", "level_samples", "source_targets"]
CLASHING = ["entity", "node", "tree", "key", "n", "id", "text_", "words", "cid", "lang_", "p", "part", "rank", "repaired", "noise", "grade", "slots", "edge"]


def empty(spark, folder) -> str:
    for t in TABLES:
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def dirty(spark, folder) -> str:
    for t in TABLES:
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        nulls = df.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
        out = df.unionByName(nulls).unionByName(nulls).unionByName(df.limit(20))
        for c in CLASHING:
            if c not in df.columns:
                out = out.withColumn(c, F.lit("clash"))
        out.write.parquet(f"{folder}/{t}.parquet")
    return str(folder)
