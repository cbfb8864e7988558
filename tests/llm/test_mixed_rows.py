from collections import Counter

from lanecost.llm import mixing
from lanecost.llm.mixing import mixed

from .helpers import table, words
from .test_mixing import brute


def test_mixed_copies_no_text_to_a_stage_and_takes_equal_rows_as_often_as_planned(spark, monkeypatch):
    rows = [(k, " ".join(words(k, 20)), "en", "a" if k < 5 else "b") for k in range(60)] + [
        (70, "same words here", "en", "a")] * 3 + [(70, "same words here", "de", "a"), (None, "same words here", None, None)]
    columns = []
    monkeypatch.setattr("lanecost.llm.mixing.written", lambda df, write=mixing.written: columns.extend(df.columns) or write(df))
    got = Counter((r.doc_id, r.lang, r.text) for r in mixed(table(spark, rows)).collect())
    assert "text" not in columns
    want = Counter()
    for (i, t, lang, _), (_, size, _, _, taken) in zip(rows, brute(rows), strict=True):
        want[i, t] += taken // size
    assert Counter({(i, t): sum(n for (j, _, u), n in got.items() if (i, t) == (j, u)) for i, t in want}) == want
    assert want[70, "same words here"] > 4
