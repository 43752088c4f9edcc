from __future__ import annotations

import pytest

from corpusmill.__main__ import main
from corpusmill.plans.service import CorpusService, NotIndexed, chunk_json


def test_service(spark, tmp_path):
    s = CorpusService(spark, f"file://{tmp_path}/corpus")
    assert s.health()["has_index"] is False and s.sources().count() == 0
    with pytest.raises(NotIndexed):
        s.index_status()
    docs = spark.createDataFrame([(1, "a.md", "# Cats\nThe Cat Club of Rome sat on the mat."), (2, "b.md", "Dogs bark in Rome at night.")], "doc_id long, source string, markdown string")
    assert s.ingest(docs, 1).count() == 2
    assert s.ingest(docs, 2).count() == 0  # both are known
    assert [(r.source, r.chunks) for r in s.sources().collect()] == [("a.md", 1), ("b.md", 1)]
    r = s.index_status().first()
    assert (r.sources, r.chunks) == (2, 2) and r.entities >= 3 and r.edges >= 3
    q = spark.createDataFrame([("1", "cat club mail x@y.de", ""), ("2", "dogs bark", "b.md")], "query_id string, query string, scope string")
    found = {(r.query_id, r.chunk_id) for r in s.retrieve(q).collect()}
    assert len(found) == 2
    ask = spark.createDataFrame([("1", "where does the cat club sit")], "query_id string, query string")
    first, again = s.chat(ask, 1).collect(), s.chat(ask, 2).collect()
    assert not first[0].cached and again[0].cached and again[0].answer == first[0].answer
    used = {r.last_used for r in s.corpus.read("cache", "key").collect()}
    assert used == {(2 << 20) + (1 << 19) + 1}  # the entry that was hit is the newest again
    frames = CorpusService.frames(s.chat(ask, 3)).orderBy("i").collect()
    assert frames[0].frame.startswith('event: token\ndata: {"text":"')
    assert chunk_json(s.index().chunks).count() == 2
    s.reset_chat()
    assert not s.corpus.has("cache") and s.health()["has_index"]
    s.reset_index()
    assert not s.health()["has_index"]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "x.md").write_text("# X\nSome words about Paris.")
    main(["--corpus", f"file://{tmp_path}/c", "--markdown", str(tmp_path / "md"), "--query", "what about Paris"])
    assert "x.md" in capsys.readouterr().out
