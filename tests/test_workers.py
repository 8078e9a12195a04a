"""All tests run on workers without a copy of the package; this one says so."""


def test_workers_have_no_copy_of_the_package(spark):
    def look(batches):
        import importlib.util
        import os

        import pandas as pd

        for _ in batches:
            yield pd.DataFrame({"found": [importlib.util.find_spec("tidewright") is not None], "path": [os.environ.get("PYTHONPATH", "")]})

    r = spark.range(1).mapInPandas(look, "found boolean, path string").first()
    assert not r["found"]
