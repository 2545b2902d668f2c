"""CSV records over several lines: a plain state machine against the split reader, at every block size."""

import random

import pytest
from pyspark.sql import functions as F

from rillwork.sources import records as L
from rillwork.sources import tables as R


def ends_inside(line, inside):
    """Reads a line character by character."""
    at, begins = 0, not inside
    while at < len(line):
        if inside:
            if line[at] == '"':
                if line[at + 1:at + 2] == '"':
                    at += 1
                else:
                    inside = False
        elif begins and line[at] == '"':
            inside = True
        begins = not inside and line[at] == ","
        at += 1
    return inside


def plain_records(text, max_lines):
    lines = text.removesuffix("\n").split("\n")
    groups, inside = [], False
    for line in lines:
        if inside:
            groups[-1].append(line)
        else:
            groups.append([line])
        inside = ends_inside(line, inside)
    out = []
    for at, group in enumerate(groups):
        if len(group) > max_lines or inside and at == len(groups) - 1:
            out += [(line, ends_inside(line, False)) for line in group]
        else:
            out.append(("\n".join(group), False))
    return sorted((r.removesuffix("\r"), broken) for r, broken in out[1:] if r.strip(" \r"))


def noisy(seed, count):
    draw = random.Random(seed)
    field = lambda: draw.choice(["a", "", "12", '"x"', '"x,y"', '"q ""z"""', '5" pipe', ' "b"', '"b"c', '""', '"line\nbreak"', '"two\n\nbreaks,\n"'])
    rows = [",".join(field() for _ in range(draw.randint(1, 4))) for _ in range(count)]
    for at in range(0, count, 17):
        rows[at] += draw.choice([',"open', '\r', ',"', ""])
    return "h1,h2,h3\n" + "\n".join(rows) + draw.choice(["", "\n"])


@pytest.mark.parametrize("seed,block,max_lines", [(1, 40, 1000), (2, 97, 5), (3, 1 << 20, 3), (4, 25, 2), (5, 64, 1000)])
def test_records_at_any_split(spark, tmp_path, seed, block, max_lines):
    texts = {f"{n}.csv": noisy(10 * seed + n, 60) for n in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, newline="")
    settings = {"spark.sql.files.maxPartitionBytes": str(block), "spark.sql.files.openCostInBytes": "0"}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        assert L._lines(spark, str(tmp_path)).rdd.getNumPartitions() >= min(20, 1000 // block)
        found = L.records(spark, str(tmp_path), max_lines)
        got = {name: sorted((r["record"], r["broken"]) for r in found.where(F.col("file").endswith(name)).collect()) for name in texts}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == {name: plain_records(text, max_lines) for name, text in texts.items()}


def test_a_stray_quote_gathers_nothing(spark, tmp_path):
    """Without a later quote the record would be the rest of the file."""
    rows = "\n".join(f"{n},x" for n in range(500))
    (tmp_path / "a.csv").write_text(f'n,t\n1,"never closed\n{rows}\n')
    assert tuple(R.tolerant_counts(spark, str(tmp_path / "a.csv")).first()) == (500, 1)
    (tmp_path / "b.csv").write_text(f'n,t\n1,"closed late\n{rows}\n7,"x"\n')
    assert tuple(R.tolerant_counts(spark, str(tmp_path / "b.csv"), max_lines=10).first()) == (501, 1)
    with pytest.raises(Exception, match="never close"):
        R.read_results(spark, str(tmp_path / "a.csv"), multi_line=True).collect()


def test_fields_of_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffn,t,u\r\n1,"x\r\ny",z\r\n\r\n2,"a\n\n""b""",c,over\n3\n', newline="")
    path = str(tmp_path / "a.csv")
    rows = sorted(map(tuple, R.read_csv_tolerant(spark, path).collect()))
    assert rows == [("1", "x\r\ny", "z"), ("3", None, None)]
    assert tuple(R.tolerant_counts(spark, path).first()) == (2, 1)


def test_headers_must_be_alike_and_of_one_line(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/1.csv").write_text("n,t\n1,2\n")
    (tmp_path / "a/2.csv").write_text("t,n\n1,2\n")
    (tmp_path / "b.csv").write_text('n,"t\nu"\n1,2\n')
    for path, word in (("a", "different"), ("b.csv", "line break")):
        with pytest.raises(ValueError, match=word):
            L.records(spark, str(tmp_path / path))


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n")
    assert R.read_csv_tolerant(spark, str(tmp_path / "a.csv")).count() == 0
    assert tuple(R.tolerant_counts(spark, str(tmp_path / "a.csv")).first()) == (0, 0)


def test_blocks_are_folded_without_lists_of_their_lines(spark, tmp_path, monkeypatch):
    """One long block: its lines are told by sums alone, and put in order a few at a time."""
    monkeypatch.setattr(L, "CHUNK", 4, raising=False)
    plans, store, sizes = [], L.checkpoint, []
    monkeypatch.setattr(L, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    blocks = L._blocks
    monkeypatch.setattr(L, "_blocks", lambda lines: sizes.append(lines.groupBy("file", "block").count().agg(F.max("count")).first()[0]) or blocks(lines))
    text = noisy(7, 400)
    (tmp_path / "one.csv").write_text(text, newline="")
    got = L.records(spark, str(tmp_path), 5).select("record", "broken").collect()
    assert sorted(map(tuple, got)) == plain_records(text, 5)
    assert not any("collect_list" in plan for plan in plans) and sizes and sizes[0] <= 16


def test_tolerant_reading_collects_no_block(spark, tmp_path, monkeypatch):
    """Broken and long records among blocks of a few lines, none of which is collected."""
    monkeypatch.setattr(L, "CHUNK", 3, raising=False)
    plans, store = [], L.checkpoint
    monkeypatch.setattr(L, "checkpoint", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or store(df))
    lines = [x for n in range(40) for x in (f'{n},"a\nb",1', f"{n},c,2", f'{n},"never', *[f"{n},p,{i}" for i in range(4)], f"{n},q,8,9")]
    text = "site,note,line\n" + "\n".join(lines) + "\n"
    (tmp_path / "one.csv").write_text(text)
    kept = [r for r, broken in plain_records(text, 3) if not broken and not r.endswith(",8,9")]
    read = R.read_csv_tolerant(spark, str(tmp_path), max_lines=3)
    assert read.count() == len(kept) > 40
    assert not any("collect_list" in plan for plan in plans)
