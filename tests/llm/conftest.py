import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def corpus(spark, tmp_path):
    """Write small tables and give back their folder: corpus(documents=[...], labels=[...])."""
    schemas = {
        "documents": DOCUMENTS,
        "labels": "doc_id long, quality int, toxic int",
        "embeddings": "vec_id long, embedding array<float>, label int",
        "conversations": "conv_id long, turn long, role string, text string",
    }

    def write(**tables):
        for name, rows in tables.items():
            spark.createDataFrame(rows, schemas[name]).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text) if text is not None else None)
