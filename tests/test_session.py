"""Sessions and stemming."""

import pytest
from pyspark.sql import functions as F

from quire.functions import stem
from quire.operators import index
from quire.plans import boolean, ranked
from quire.plans.session import Session, SettingError


@pytest.fixture(scope="module")
def session(spark):
    docs = spark.createDataFrame([(1, "the cat\nsat"), (2, "a dog and a cat"), (3, "nothing here")], "docnum long, text string")
    return Session(index.build(docs))


def test_settings(session):
    session.push()
    session.run(".set maxdocs 1")
    assert [r["docnum"] for r in session.run("cat | dog").collect()] == [1]
    session.pop()
    assert session.settings["maxdocs"] == "all"
    for bad in (".set maxdocs 0", ".set query sql", ".set heads_length 1001", ".unset mode", ".pop", ".nothing", ".set verbatim maybe"):
        with pytest.raises(SettingError):
            session.run(bad)
    session.load("# settings\n.set mode count\n.set query ranked\n")
    assert session.run("cat nowhere").first()["documents"] == 2 and session.run(".queryterms") == "cat"
    assert "mode = count" in session.run(".display")
    session.reset()
    assert session.settings["mode"] == "text"


def test_modes(session):
    session.reset()
    assert sorted(r["docnum"] for r in session.run('cat "^sat"').collect()) == [1]
    session.set("mode", "heads")
    assert [r["head"] for r in session.run("cat & !dog").collect()] == ["the cat sat"]
    session.set("mode", "hilite")
    assert [r["text"] for r in session.run("dog").collect()] == ["a <U>dog</U> and a cat"]
    session.set("mode", "docnums")
    session.set("query", "docnums")
    assert sorted(r["line"] for r in session.run("2 3").collect()) == ["       2   1.0000        15", "       3   1.0000        12"]
    session.reset()


def test_stem(spark):
    endings = [("ationally", "B"), ("ally", "B"), ("ing", "N"), ("s", "W"), ("ed", "E"), ("ic", "A"), ("ation", "B"), ("e", "A"), ("al", "BB")]
    words = ["nationally", "rationally", "sitting", "sing", "buses", "glass", "metal", "crystal", "national", "added", "be", "a", "flies", "xe"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: r[1] for r in df.select("w", stem.stem(F.col("w"), endings)).collect()}

    assert got == {w: stem.stemmed(w, endings) for w in words}
    assert got["sitting"] == "sit" and got["metal"] == "metal" and got["crystal"] == "crystal"


def test_recoding(spark):
    """Published examples, and each rewrite with the letters that forbid it."""
    words = [f"x{before}{end}" for end, _, never in stem.REWRITES for before in ["", "q", *never]]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r[0]: r[1] for r in df.select("w", stem.recoding(F.col("w"))).collect()}
    assert got == {w: stem.recoded(w) for w in words}
    assert stem.recoded("believ") == "belief" and stem.recoded("induct") == "induc" and stem.recoded("dissolv") == "dissolut" and stem.recoded("sitt") == "sit"
    assert got["xaul"] == "xaul" and got["xqul"] == "xql" and got["xsend"] == "xsend" and got["xqend"] == "xqens"


def test_stemmed_collection(spark, tmp_path):
    path = tmp_path / "endings"
    path.write_text("ing N # a comment\ns W\ned E\n\n")
    docs = spark.createDataFrame([(1, "sitting dogs"), (2, "a dog barked"), (3, "sits")], "docnum long, text string")
    c = index.build(docs, endings=stem.read(str(path)))
    assert {r["term"] for r in c.lexicon.collect()} == {"sit", "dog", "a", "bark"}
    assert sorted(r["docnum"] for r in boolean.matches(c, "dogs").collect()) == [1, 2] == sorted(r["docnum"] for r in ranked.ranked(c, "DOGS").collect())
    path.write_text("ing NN\n")
    with pytest.raises(ValueError):
        stem.read(str(path))


def test_commands(session, tmp_path):
    session.reset()
    (tmp_path / "rc").write_text("# own\n.set mode count\n")
    assert session.started(str(tmp_path / "none"), str(tmp_path / "rc")).settings["mode"] == "count"
    (tmp_path / "lines").write_text("cat & \\\ndog\n.queryterms\n")
    found = session.run(f".input {tmp_path / 'lines'}")
    assert found[0].first()["documents"] == 1 and found[1] == "cat dog"
    assert ".quit" in session.run(".help")
    assert session.read("cat\n.quit\ncat")[0].first()["documents"] == 2 and not session.open
    session.open = True
    session.reset()
