import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(tmp_path_factory, spark):
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
    return spark.conf.get("spark.checkpoint.dir")


@pytest.fixture
def documents(spark):
    def make(rows, extra=""):
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + extra)

    return make
