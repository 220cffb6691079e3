import hashlib
from collections import defaultdict

from lexiscore.llm import line_dedup
from tests.llm.cases import awkward

SPACE = " \t\n\x0b\x0c\r"


def plain(rows, min_chars=20, min_docs=3):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            k = key(line)
            known = [d for d in holders[k] if d is not None]
            shared = len(k) >= min_chars and len(holders[k]) >= min_docs
            if not shared or doc == max(known):
                kept.append(line)
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


SHARED = "This line of text is Shared by many"
ROWS = [
    (10, f"own line one\n{SHARED}\n  {SHARED.upper()} \nlast"),
    (11, f"{SHARED}\n"),
    (12, f"\t{SHARED}\r\n{SHARED}"),
    (13, "short\nshort"),
    (14, "ÉCLAIR au chocolat et à la crème\nx"),
    (15, "éclair au chocolat et à la crème\nx"),
    (16, "ÉCLAIR AU chocolat et à la crème\nx"),
    (None, SHARED),
    (17, None),
    (18, ""),
    (19, f"{SHARED}x"),
    (20, "a line that only two documents have\n" * 3),
    (21, "a line that only two documents have"),
]


def test_against_a_plain_version(spark):
    df = awkward(spark, ROWS)
    got = line_dedup.drop_shared_lines(df, n_lines="n_lines", n_dropped="n_dropped")
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    rows = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(plain(ROWS), key=str)


def test_awkward_rows_come_back(spark):
    df = awkward(spark)
    got = line_dedup.drop_shared_lines(df)
    want = sorted((str(r.doc_id), r.text or "") for r in df.collect())
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == want
    empty = line_dedup.drop_shared_lines(df.limit(0))
    assert empty.count() == 0 and empty.columns == df.columns


def test_a_line_in_very_many_documents(spark):
    rows = [(i, f"own {i}\n{SHARED}") for i in range(400)]
    got = {r.doc_id: r.text for r in line_dedup.drop_shared_lines(awkward(spark, rows)).collect()}
    assert got.pop(399) == f"own 399\n{SHARED}"
    assert got == {i: f"own {i}" for i in range(399)}


def test_main_path_has_no_python(spark):
    plan = line_dedup.drop_shared_lines(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


def test_digest_of_an_empty_text(spark):
    from lexiscore.llm.queries import QUERIES

    rows = QUERIES["op4_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(len(r.kept_sha256) == len(hashlib.sha256().hexdigest()) for r in rows)
