from pyspark.sql import functions as F

from brindle.llm.line_dedup import drop_lines

SCHEMA = "id long, host string, text string, lines string"


def brute(rows):
    lines = lambda t: [x for x in (" ".join(s.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").split(" ")).strip() for s in (t or "").split("\n")) if x]
    squeeze = lambda s: " ".join(x for x in s.split(" ") if x)
    pages, on = {}, {}
    for _, h, t, _ in rows:
        h = h or ""
        pages[h] = pages.get(h, 0) + 1
        for x in {squeeze(x) for x in lines(t)}:
            on[h, x] = on.get((h, x), 0) + 1
    out = []
    for i, h, t, _ in rows:
        h = h or ""
        all_ = [squeeze(x) for x in lines(t)]
        stay = [x for x in all_ if not 100 * (on[h, x] - 1) > 30 * pages[h]]
        out.append((i, h, len(all_), len(all_) - len(stay), "\n".join(stay)))
    return out


def test_matches_brute_force(spark):
    rows = [(i, f"h{i % 4}", f"menu\n  line {i}\nfoot \t er\nmenu\n{'rare' if i % 9 == 0 else i}", "x") for i in range(80)]
    rows += [(100, None, "menu", "x"), (101, None, None, None), (102, "", "", None), (103, "lone", "menu\nmenu", "x"), (104, None, "menu", "x"), (105, None, "menu", "x"), (106, "long", "word " * 200000, "x")]
    rows += rows[:5]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = drop_lines(df, F.col("host"), F.col("text"))
    assert out.columns == ["id", "host", "text", "lines", "_lines"]
    got = [(r.id, *r["_lines"]) for r in out.collect()]
    assert sorted(got) == sorted(brute(rows))
    assert drop_lines(df.limit(0), F.col("host"), F.col("text")).count() == 0


def test_clashing_names_and_dropped_html(spark):
    from brindle.llm.line_dedup import drop_page_lines

    rows = [(i, f"http://h/{i}", f"<p>menu</p><p>text {i}</p>", "a", ["b"], None) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host_of_row string, lines_of_row array<string>, digests_of_host string")
    out = drop_page_lines(df)
    assert out.columns == [*df.columns, "lines"]
    assert {(r.page_id, r.host_of_row, tuple(r.lines_of_row), r.lines.text) for r in out.collect()} == {(i, "a", ("b",), f"text {i}") for i in range(9)}
    assert drop_page_lines(df, with_html=False).columns == [c for c in out.columns if c != "html"]
