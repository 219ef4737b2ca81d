import numpy as np
import pytest

from lodestone.llm import language

TEXTS = {
    "en": "the house of the people and that is what they have been working for with all their might",
    "fr": "la maison des enfants est dans la rue qui mène vers la gare et nous y allons avec plaisir",
    "de": "das Haus der Kinder steht an der Straße und wir gehen nicht mit den anderen dorthin zurück",
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i * 10 + k, " ".join(np.random.default_rng(i).permutation(t.split())), lang, "s", 0) for k, (lang, t) in enumerate(TEXTS.items()) for i in range(30)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def page(i, url, lang, text):
    declared = f' lang="{lang}-XX"' if lang else ""
    return (i, url, f"<!DOCTYPE html><html class=x{declared}><head><script>var t='<p>';</script></head><nav>das der die</nav><!-- c --><p>{text}</p></html>")


def test_pages(spark, model):
    rows = [page(i, f"https://a.example.{'fr' if i % 2 else 'com'}/x", "fr" if i % 2 else "en", TEXTS["fr" if i % 2 else "en"]) for i in range(40)]
    rows += [page(100, "http://A.example.fr:80/q", "", "la rue"), page(101, "http://a.example.com", "de", TEXTS["en"]), (102, None, None), (103, "x", "<html lang=de>12 34</html>")]
    got = {r.page_id: r for r in language.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert all(got[i].lang_id == ("fr" if i % 2 else "en") and got[i].lang_confidence > 0.9 for i in range(40))
    assert got[100].lang_id == "fr" and got[101].lang_id == "en"
    assert got[102].lang_id == got[103].lang_id == "und" and not got[102].lang_accepted


def test_prior_of_the_host_decides_where_text_does_not(model):
    flat = np.zeros((1, 3))
    corpus, host = np.array([100.0, 100, 100]), np.array([[60.0, 0, 0]])
    args = dict(suffix=host * 1.0, corpus=corpus, declared=np.zeros((1, 3)), by_declared=np.zeros(3))
    said = language.fuse(model, flat, host=host, has=np.array([False]), **args)
    assert said.argmax() == 0 and said.max() > 0.6
    # A row's own share gives it no prior: a host of this row alone says nothing.
    own = language.fuse(model, flat, host=np.full((1, 3), 1 / 3), has=np.array([False]), **(args | {"suffix": np.full((1, 3), 1 / 3)}))
    assert np.allclose(own, 1 / 3, atol=0.01)
    declared = language.fuse(model, flat, host=np.full((1, 3), 1 / 3), has=np.array([True]), **(args | {"suffix": np.full((1, 3), 1 / 3), "declared": np.array([[0.0, 50, 2]]), "by_declared": np.array([60.0, 60, 60])}))
    assert declared.argmax() == 1


def test_odd_rows(spark, odd, model):
    from pyspark.sql import functions as F

    for df in (odd, odd.limit(0)):
        out = language.identify(df, model, text=F.col("text"), host=F.col("source"), suffix=F.lit(""), declared=F.col("lang"))
        rows = out.collect()
        assert len(rows) == df.count() and out.columns[: len(df.columns)] == df.columns
        assert all(r.lang_id == "und" for r in rows if not (r.text or "").strip())


def test_clashing_columns(spark, model):
    from pyspark.sql import functions as F

    names = ["_t", "_h", "_s", "_d", "_hv", "_sv", "_dv", "__h", "lang_id", "Q0", "a.b"]
    df = spark.createDataFrame([(*[f"{n}{i}" for n in names], TEXTS["fr"]) for i in range(5)], [*names, "body"])
    args = dict(text=F.col("body"), host=F.col("_h"), suffix=F.col("_s"), declared=F.col("_d"))
    out = language.identify(df, model, **args)
    assert out.columns == [*[n for n in names if n != "lang_id"], "body", "lang_id", "lang_best", "lang_confidence", "lang_accepted"]
    assert sorted((r["_t"], r["__h"], r["a.b"], r["lang_id"]) for r in out.collect()) == [(f"_t{i}", f"__h{i}", f"a.b{i}", "fr") for i in range(5)]
    assert language.identify(df, model, **args, keep=["_h"]).columns == ["_h", "lang_id", "lang_best", "lang_confidence", "lang_accepted"]


def brute(model, rows):
    """The posterior of each page from its neighbours' counts, one page after the other."""
    p, langs = model.p, model.langs
    lik = [model.of([text])[0][0] for _, _, _, text in rows]
    soft = [np.exp(x - x.max()) / np.exp(x - x.max()).sum() for x in lik]
    out = []
    for i, (host, suffix, said, _) in enumerate(rows):
        others = [j for j in range(len(rows)) if j != i]
        count = lambda test: sum((soft[j] for j in others if test(rows[j])), np.zeros(len(langs)))
        base = count(lambda r: True) + 1
        base /= base.sum()
        mid = count(lambda r: r[1] == suffix)
        mid = (mid + p.suffix * base) / (mid.sum() + p.suffix)
        top = count(lambda r: r[:2] == (host, suffix))
        top = (top + p.host * mid) / (top.sum() + p.host)
        post = lik[i] + np.log(top)
        if said:
            by, every = count(lambda r: r[2] == said), count(lambda r: r[2] != "")
            rate = (by.sum() + 1) / (every.sum() + 2)
            post = post + np.log((by + p.declared * rate) / (every + p.declared))
        post = np.exp(post - post.max())
        out.append(post / post.sum())
    return out


def test_posterior_equals_brute_force(spark, model):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(8)
    rows = []
    for i in range(200):
        lang = ["en", "fr", "de"][rng.integers(3)]
        words = rng.choice(TEXTS[lang].split(), rng.integers(0, 4)).tolist()
        rows.append((f"h{rng.integers(9)}", ["fr", "com", ""][rng.integers(3)], ["", lang, "en"][rng.integers(3)], " ".join(words)))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, host string, suffix string, said string, body string")
    out = language.identify(df, model, text=F.col("body"), host=F.col("host"), suffix=F.col("suffix"), declared=F.col("said"), keep=["id"])
    got = {r.id: (r.lang_best, r.lang_confidence) for r in out.collect()}
    for i, post in enumerate(brute(model, rows)):
        assert abs(got[i][1] - post.max()) < 1e-4, rows[i]
        assert got[i][0] == model.langs[post.argmax()] or np.sort(post)[-1] - np.sort(post)[-2] < 1e-4


def test_nothing_known(spark, odd):
    from pyspark.sql import functions as F

    none = language.fit(odd)
    out = language.identify(odd, none, text=F.col("text"), host=F.col("source"), suffix=F.lit(""), declared=F.col("lang"))
    assert not any(r.lang_accepted for r in out.collect())


def test_large_tables_are_joined(spark, model, monkeypatch):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, TEXTS["de"], f"h{i % 3}") for i in range(12)], "i int, text string, source string")
    args = dict(text=F.col("text"), host=F.col("source"), suffix=F.lit("x"), declared=F.lit(None).cast("string"))
    a = sorted(map(tuple, language.identify(df, model, **args).collect()))
    monkeypatch.setattr(language, "SMALL_ROWS", 0)
    assert sorted(map(tuple, language.identify(df, model, **args).collect())) == a
