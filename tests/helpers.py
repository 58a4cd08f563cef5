from pyspark.sql import functions as F

from sigwin import schemas as S


def events_df(spark, rows):
    """rows: (contig, position, kmer, level, stdv, length, model_stdv, std_level, ord)."""
    return spark.createDataFrame(rows, S.EVENT_SCHEMA)


def site_rows(contig, positions, kmer="GGACT", value=1.0):
    out = []
    for p in positions:
        out.append((contig, p, kmer) + tuple(float(value + p + i) for i in range(8)))
    return out


def sites_df(spark, rows):
    return spark.createDataFrame(rows, S.SITE_SCHEMA)


def col_values(df, col, order=("contig", "position")):
    return [r[0] for r in df.orderBy(*order).select(F.col(S.q(col))).collect()]
