"""A small scanned file with every kind of noise, and odd inputs."""

from tallyroot.llm import scans

SCHEMA = "id long, parent_id long, content string, position int, usetype string, updated_at int, file int, w string"

WORDS = "the quarterly review shows that every worker keeps the frequency counts of the nightly index without any warning and the half-finished transcript returns with results"
PAGES = [
    "MURAL REPAIRS OF THE NORTH WING\n\nThe quarterly review shows that every wor-\nker keeps the frequency counts of the night-\nly index without any warn\ning and the half-\nfinished transcript returns.\n\n1965\n2016\n\nThe revievv shows tbe counts and the quar-\n- 1 -",
    "MURAL REPAIRS OF THE N0RTHH WING\nterly results. Every worker keeps the frequericy\ncounts of the index. It shows re-\n\n- 2 -",
    "MURAL REPARS OF THE NORTH WING\n\nsults without warning.\n2.1 The worker\n- l3 -".replace("l3", "3"),
]


def nodes(spark):
    rows = [(i, 900, p, i, "scan:page", 2, 0, "x") for i, p in enumerate(PAGES, 1)]
    rows += [(2, 900, "old version", 1, "scan:page", 1, 0, "x"), (3, 900, PAGES[2], 3, "scan:page", 2, 0, "x")]
    rows += [(i, 5, WORDS, None, "chunk", 1, 0, "x") for i in range(100, 112)]
    rows += [(200, None, None, 1, "scan:page", 1, 0, "x"), (201, None, "", 1, "scan:page", 1, 0, "x"), (202, None, "\n\n", None, "scan:page", 1, 0, "x"), (None, 1, "a\nb", 1, "scan:page", 1, 0, "x")]
    return spark.createDataFrame(rows, SCHEMA)


def test_kinds(spark):
    found = {tuple(r) for r in scans.scan_noise(nodes(spark))[0].collect()}
    kinds = lambda page, kind: {no for i, no, k in found if i == page and k == kind}
    assert [kinds(i, "running") for i in (1, 2, 3)] == [{1}, {1}, {1}]
    assert [kinds(i, "page_no") for i in (1, 2, 3)] == [{13}, {5}, {5}]
    assert [kinds(i, "broken") for i in (1, 2, 3)] == [{3, 4, 5, 12}, {3}, set()]
    assert [kinds(i, "misread") for i in (1, 2, 3)] == [{12}, {2}, set()]
    assert {i for i, _, _ in found} == {1, 2, 3}


def test_paragraphs(spark):
    rows = sorted((r.id, r.line_no, r.text) for r in scans.paragraphs(nodes(spark)).collect())
    assert rows[0] == (1, 3, "The quarterly review shows that every worker keeps the frequency counts of the nightly index without any warning and the half-finished transcript returns.")
    assert rows[2][2].startswith("The review shows the counts and the quarterly results. Every worker keeps the frequency counts of the index. It shows results without warning.")


def test_forms():
    assert scans.page_number("- 12 -") == (12, "-#") and scans.page_number(" Page 5 .") == (5, "page#") and scans.page_number("xiv") == (14, "r#")
    assert scans.page_number("3 / 10") == (3, "#/#") and scans.page_number("[l54]")[0] == 154 and scans.page_number("The end") is None and scans.page_number("") is None
    assert scans.running_form("Tenant letters   3") == scans.running_form("Tenant 1etters") and scans.running_form("3.4 Our queue") is None 
    assert scans.skeleton("waming") == scans.skeleton("warning") and scans.skeleton("previoiis") == scans.skeleton("previous") and scans.skeleton_in("drillmg") == scans.skeleton_in("drilling")


def test_running(spark):
    """Lines that a single file repeats by chance are not running elsewhere; nor are lines repeated far apart."""
    head = "Annual survey of the lower basin"
    body = lambda i, j: f"line {'abcdefghij'[i % 10] * 3} of {'klmnopqrst'[j % 10] * 4} text goes on"
    pages = [(100 + j, 1, f"{head}\n{body(j, 1)}\n{body(j, 2)}\n{body(j, 3)}\n{body(j, 4)}\nend of {'uvwxyz'[j % 6] * 5} here", j) for j in range(6)]
    far = "Minor remarks of both readers"
    pages += [(200 + j, 2, f"{far if j in (0, 40) else body(j, 5) + str(j) * 3}\n{body(j, 6)}\n{body(j, 7)}\nx{j} {body(j + 1, 8)}", j) for j in range(41)]
    pages += [(300 + j, 3, f"{head if j == 1 else 'Foreword by ' + 'nobody' * j}\n{body(j, 9)}\nit ends {'so' * (j + 3)}", j) for j in range(3)]
    rows = [(k, f, c, p, "scan:page", 1, 0, "x") for k, f, c, p in pages]
    found = {(i, no) for i, no, k in scans.scan_noise(spark.createDataFrame(rows, SCHEMA))[0].collect() if k == "running"}
    assert {(100 + j, 1) for j in range(6)} <= found and (301, 1) in found
    assert not {(200, 1), (240, 1)} & found


def test_empty(spark):
    df = nodes(spark)
    assert scans.scan_noise(df.limit(0))[0].count() == 0 and scans.paragraphs(df.limit(0)).count() == 0
    assert scans.scan_noise(df.where("usetype = 'chunk'"))[0].count() == 0
