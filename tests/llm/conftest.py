import os

import pytest


class Tables:
    """Writes small tables into a folder that a query can read like the supplied ones."""

    SCHEMAS = {
        "documents": "doc_id long, text string, lang string, source string, n_chars long",
        "labels": "doc_id long, quality int, toxic int",
        "benchmark": "item_id long, text string",
        "pages": "page_id long, url string, html string",
    }

    def __init__(self, spark, root):
        self.spark, self.root = spark, root

    def folder(self, name, **tables):
        path = os.path.join(self.root, name)
        for table, schema in self.SCHEMAS.items():
            rows = tables.get(table, [])
            self.spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{table}.parquet")
        return path

    def documents(self, name, rows, **tables):
        """``rows``: (doc_id, text) or (doc_id, text, lang, source)."""
        full = [(r[0], r[1], *(r[2:] or ("en", "s0")), None) for r in rows]
        return self.folder(name, documents=full, **tables)


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    return Tables(spark, str(tmp_path_factory.mktemp("llm")))
