from collections import Counter

from lanecost.llm.linededup import drop_boilerplate

from .helpers import odd_rows, table


def brute(rows, ratio, least):
    pages, holding = Counter(), Counter()
    for text, host in {(text, host) for _, text, _, host in rows}:
        pages[host] += 1
        if text is not None:
            for line in set(text.split("\n")):
                if line.strip(" "):
                    holding[host, line] += 1
    out = []
    for i, text, _, host in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        own = text.split("\n")
        kept = [x for x in own if not (holding[host, x] >= least and holding[host, x] > ratio * pages[host])]
        out.append((i, "\n".join(kept), len(own), len(own) - len(kept)))
    return out


def check(spark, rows, ratio, least):
    out = drop_boilerplate(table(spark, rows), ratio=ratio, min_pages=least)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(brute(rows, ratio, least), key=key)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "n_lines", "n_dropped"]


def test_matches_brute_force(spark):
    rows = [(k, f"menu\npage {k}\nhome {k % 3}\n\nmenu", "en", f"s{k % 2}" if k % 7 else None) for k in range(60)]
    check(spark, rows, 0.3, 3)
    check(spark, rows, 0.9, 3)


def test_odd_rows(spark):
    check(spark, odd_rows(), 0.5, 2)
    check(spark, odd_rows(), 0.01, 1)


def test_hot_host_and_empty_table(spark):
    check(spark, [(k, "same\n" + str(k), "en", "hot" if k < 900 else "other") for k in range(1000)], 0.5, 5)
    assert drop_boilerplate(table(spark, [])).count() == 0



def test_copies_of_a_page_are_not_boilerplate(spark):
    rows = [(k, f"footer\nown {k}", "en", "h") for k in range(100)]
    rows += [(200 + k, f"story {k // 6}\ntold at length {k // 6}", "en", "h") for k in range(12)]
    check(spark, rows, 0.03, 5)
    out = {r.doc_id: r.text for r in drop_boilerplate(table(spark, rows), ratio=0.03, min_pages=5).collect()}
    assert out[200] == "story 0\ntold at length 0" and out[7] == "own 7"
