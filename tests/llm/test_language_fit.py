import pytest

from lanecost.llm import langid

from .helpers import table
from .test_language_and_pipeline import prose


def labelled():
    return [(k, prose(lang, k, 60), lang, "s") for k, lang in enumerate(["aa", "bb", "cc"] * 20)]


def test_a_stray_label_does_not_shrink_the_other_dictionaries(spark):
    clean = langid.fit(table(spark, labelled()))
    model = langid.fit(table(spark, [*labelled(), (900, "bonjour tous", "dd", "s")]))
    assert {k: model[k] for k in clean} == clean and model["dd"] == b"bonjour tous"
    assert len(clean["aa"]) > 4000
    out = [langid.judge(prose(k, f"new{n}", 30), tuple(sorted(model.items())), 0.003) for k in clean for n in range(10)]
    assert [o[0] for o in out] == [k for k in clean for _ in range(10)] and not any(o[2] for o in out)


def test_repeated_rows_leave_the_sample_as_it_is(spark):
    rows = labelled()
    copies = [(1000 + k, rows[0][1], "aa", "s") for k in range(2000)]
    assert langid.fit(table(spark, [*rows, *copies]), passages=5) == langid.fit(table(spark, rows), passages=5)


def test_one_label_has_all_its_room(spark):
    assert langid.fit(table(spark, [(1, "Ab cd", "x", "s")])) == {"x": b"ab cd"}
    assert langid.fit(table(spark, [(1, "Ab cd", "x", "s")]), dictionary_bytes=2) == {"x": b"ab"}


@pytest.mark.parametrize("poor", [1, 3, 8])
def test_unequal_dictionaries_are_made_up_for(spark, poor):
    # however little a label gathered, the others keep all they have and no verdict jumps
    rows = [r for k, r in enumerate(labelled()) if r[2] != "cc" or k < 3 * poor]
    model = langid.fit(table(spark, rows))
    assert len(model["aa"]) > 4000 and len(model["cc"]) < len(model["aa"]) / 2
    found = [(k, langid.judge(prose(k, f"new{n}", 40), tuple(sorted(model.items())), 0.003)[0]) for k in model for n in range(20)]
    assert sum(k == f for k, f in found) >= 0.95 * len(found)


def test_a_very_long_text_is_judged_whole(spark):
    model = tuple(sorted(langid.fit(table(spark, labelled())).items()))
    text = prose("aa", "short", 30) + " " + prose("bb", "long", 60_000)
    assert langid.judge(text, model, 0.003)[0] == "bb"
    sizes = langid.sizes(text, langid._compressors(model))
    length = len(text.encode())
    want = min((n - o * length, k) for n, o, (k, _) in zip(sizes, langid.offsets(model), model, strict=True))
    assert langid.judge(text, model, 0.003)[0] == want[1]
