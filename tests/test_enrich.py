from pyspark.sql import functions as F

from gazette.functions import payload
from gazette.operators import enrich


def test_payloads(spark):
    assert payload.items('```json\n{"decisions": [{"a": 1}]}\n```') == [{"a": 1}]
    assert payload.items('Sure: [1, 2] ok') == [1, 2] and payload.items('"[3]"') == [3] and payload.items("no") == [] and payload.items(None) == []
    df = spark.createDataFrame([('{"items": [{"b": 2, "a": "ü"}]}',), (None,)], "p string")
    assert [r[0] for r in df.select(payload.payload_items(F.col("p"))).collect()] == [['{"a": "ü", "b": 2}'], []]


def test_translate_once(spark):
    df = spark.createDataFrame([(1, "ciao", "ciao"), (2, "bad", ""), (3, None, "x")], "pos long, title string, summary string")

    def translator(t):
        if t == "bad":
            raise ValueError
        return t.upper()

    got = {r["pos"]: (r["title_translated"], r["summary_translated"]) for r in enrich.translate(df, ["title", "summary"], translator).collect()}
    assert got == {1: ("CIAO", "CIAO"), 2: (None, None), 3: (None, "X")}


def test_refresh_and_errors(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert {r["k"]: r["v"] for r in enrich.refresh(old, new, "k").collect()} == {"a": 1, "b": 3, "c": 4}
    notes = spark.createDataFrame([("error", "Read timed out"), ("error", "HTTP 403"), ("ok", "timeout"), ("error", None)], "status string, note string")
    assert {r["category"]: r["n"] for r in enrich.error_histogram(notes).collect()} == {"read_timeout": 1, "blocked": 1, "unknown": 1}
    aliases = spark.createDataFrame([("Shop", "shop", 0), ("Shop", "sh", 1), ("TTS", "tts", 0)], "platform string, alias string, pos int")
    assert {r["platform"]: (r["alias_count"], r["has_full_name"], r["abbreviation_only"], len(r["warnings"])) for r in enrich.alias_summary(aliases).collect()} == {"Shop": (2, True, False, 0), "TTS": (1, False, True, 2)}


def test_summary_fallback(spark):
    """Blank summaries come from the stored page of their day; others stay; each text is translated once."""
    rows = spark.createDataFrame([(1, "https://a.example/1", "2024-01-02", "T", ""), (2, "https://a.example/1", "2024-01-05", "T", None), (3, "https://a.example/2", "", "", " "), (4, "https://a.example/1", "2024-01-02", "T", "own"), (5, None, "2024-01-02", "T", ""), (6, "https://a.example/3", "2024-01-02", "T", "")], "pos long, article_url string, published_at string, title string, summary string")
    pages = spark.createDataFrame([("https://a.example/1", "2024-01-02T10:00:00", "P", "said of it", "A body of its own."), ("https://a.example/2", "", "", "no title at all", ""), ("https://a.example/3", "", "", "", "only a body")], "url string, published_at string, title string, summary string, body_excerpt string")
    got = {r["pos"]: r["summary"] for r in enrich.summary_fallback(rows, pages).collect()}
    assert got[1].startswith("said of it") and (got[2], got[3], got[4], got[5], got[6]) == ("", "", "own", "", "only a body")
    upper = lambda df: enrich.translate(df, ["summary"], lambda t: t.upper() if t.startswith("said") else "")
    again = {r["pos"]: r["summary"] for r in enrich.summary_fallback(rows, pages, upper).collect()}
    assert again == {**got, 1: got[1].upper()}
