import numpy as np
import zlib

from palimpsest.llm import language as L


def grams(text):
    codes, out = [ord(c) for c in text.lower()], set()
    for n in range(1, L.LONGEST + 1):
        for at in range(len(codes) - n + 1):
            value = 0
            for code in codes[at:at + n]:
                value = (value * 0x01000193 + code) % 2 ** 32
            out.add(((value + n) % 2 ** 32 * 0x9E3779B1) % 2 ** 32 >> 17)
    return out


def test_presence_is_the_set_of_all_grams(monkeypatch):
    monkeypatch.setattr(L, "_STEP", 7)
    for text in ["", "a", "Straße é", "abcabcabc " * 5, "🙂x"]:
        row = np.zeros(L.SLOTS)
        L.presence(text, row)
        assert set(np.flatnonzero(row)) == grams(text)


def test_folded_weights_equal_the_kernel_expansion():
    random = np.random.default_rng(2)
    rows = (random.random((40, L.SLOTS)) < 0.01).astype(np.uint8)
    labels = ["a" if n % 2 else "b" for n in range(40)]
    names, weights = L.fit(np.packbits(rows, axis=1), labels, landmarks=40)
    x = rows.astype(float)
    kernel = x @ x.T / np.sqrt(np.outer(x.sum(1), x.sum(1)))
    plain = kernel @ np.linalg.solve(kernel.T @ kernel + L.RIDGE * 40 * kernel + 1e-6 * np.eye(40), kernel.T @ np.where(np.array(labels)[:, None] == np.array(names), 1., -1.))
    assert np.allclose(x @ weights / np.sqrt(x.sum(1))[:, None], plain, atol=1e-3)


def sentences(word, count, start):
    return [(start + n, f"{word}{n} {word} {word[::-1]}{n % 7} {word}", None) for n in range(count)]


def test_held_out_rows_edges_and_extra_columns(spark):
    rows = [(i, t, "aa") for i, t, _ in sentences("oui lettre", 60, 0)] + [(i, t, "bb") for i, t, _ in sentences("könnte wär", 60, 100)]
    rows += [(500, None, "aa"), (501, "", "aa"), (502, "12 !!", "bb"), (503, "oui lettre", None), (None, "oui lettre", "zz"), (504, "oui lettre " * 20000, "aa"), (1, rows[1][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as whole", "'q' as lang_pred", "2 as id")
    got = L.predict_languages(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: r for r in got}
    for id_, text, lang in rows:
        row = by[id_]
        assert row["held_out"] == (zlib.crc32(("" if id_ is None else str(id_)).encode()) % 3 == 1) and 0 <= row["score"] <= 1
        assert row["lang_pred"] == ("und" if id_ in (500, 501, 502) else "aa" if "oui" in text else "bb")
    kept = L.keep_identified(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.predict_languages(none).count() == 0 and L.keep_identified(none).count() == 0
    one = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.predict_languages(one).select("id", "lang_pred", "score").collect()] == [(1, "und", 0.0)]
    assert L.keep_identified(one).count() == 1


def test_letters_alone_are_no_language(spark):
    random = np.random.default_rng(3)
    vocabulary = {lang: ["".join(random.choice(list(letters), 3)) + end for end in ends for _ in range(40)]
                  for lang, letters, ends in (("aa", "aeioulmn", ("ing", "tion", "")), ("bb", "aeußkrst", ("en", "heit", "")))}
    clean = [(n, " ".join(random.choice(vocabulary[lang], 60)), lang) for n, lang in enumerate(["aa", "bb"] * 150)]
    clean += [(1000 + n, " ".join(random.choice(vocabulary["aa"], 3)), None) for n in range(20)]
    noise = lambda signs, count: " ".join("".join(random.choice(list(signs), random.integers(1, 12))) for _ in range(count))
    junk = [noise("bcdfghjpqvwxyz", 80), noise("0123456789", 80) + " a", noise("#$%&*!?@^~", 80) + " x", noise("0123456789abcdef", 80)]
    df = spark.createDataFrame(clean + [(2000 + n, text, None) for n, text in enumerate(junk)], "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in L.keep_identified(df).collect()) == [r[0] for r in clean]
