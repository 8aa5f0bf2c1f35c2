"""Terms that disclose nothing make no rows on their way to the exact join."""

from gridlore.llm import pii


def letters(n):
    return "".join(chr(97 + n // 26**k % 26) for k in range(5))


def test_only_flagged_terms_make_rows(spark, monkeypatch):
    seen = {}

    def kept(df, name, make=pii.materialize):
        seen[name] = make(df, name)
        return seen[name]

    monkeypatch.setattr(pii, "materialize", kept)
    words = " ".join(letters(i) for i in range(0, 26**5, 60))
    rows = [(i, f"{w} zebrafish writes a.b@c.org") for i, w in enumerate(["morning", "evening", "midnight"])] + [(9, words + " zebrafish")] + [(100 + i, "nothing") for i in range(300)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    flagged = {r["t"] for r in seen["pii-flagged"].collect()}
    assert pii._hash("zebrafish") in flagged
    assert {r["t"] for r in seen["pii-terms"].collect()} <= flagged
    assert got[9].endswith(f"term:{len(words) + 1}:{len(words) + 10}") and "term:8:17" in got[0]
    monkeypatch.setattr(pii, "EXACT", 0)  # by the bit map: the same spans
    assert {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == got
