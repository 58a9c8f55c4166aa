import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session", autouse=True)
def package_on_workers(spark):
    from recordloom.session import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table of (id, text[, lang]) rows."""

    def make(*rows):
        full = [(*r, *[None] * (3 - len(r)), None, None) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


def clashing(frame):
    """The frame with columns named like those the operators use inside."""
    from pyspark.sql import functions as F

    own = {c.lower() for c in frame.columns}
    names = "uid key digest node component spans size n sig label ids pos keep_id kept at lang_pred hits u v"
    return frame.withColumns({c: F.lit("x") for c in names.split() if c not in own})
