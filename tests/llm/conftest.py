import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """The small documents, and rows with nulls, blanks, repeats, marks alone, a long text; columns with names the operators use."""
    own = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang")
    odd = [
        (None, "An id that is null here.", "en"), (90001, None, "en"), (90002, "", None), (90003, " \n\t ", "en"), (90004, "12 34 !!", "de"),
        (90005, "same row", "en"), (90005, "same row", "en"), (90006, "A" * 3000, None), (90007, "one  Two\nthree\none two", "fr"), (90008, "word " * 30000, "en"),
        (90009, "not<|endoftext|>Yet <|startoftext|> \u0130stanbul \u03a3\u0391\u03a3 na\u00efve\u0301 x\u00b2 WE\u2019LL can\u0027t", "en"),
    ]
    both = own.unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    clashing = ["digest", "fp", "row", "kept", "score", "size", "part", "doc", "label", "language", "root", "keep_id"]
    return both.withColumns({name: F.lit("x") for name in clashing}).repartition(3).cache()


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")
