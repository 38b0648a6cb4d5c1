import hashlib
import random
from collections import Counter

import public_tokenizers as public
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palimpsest.llm import alignment as A


@pytest.fixture(scope="module")
def both():
    return A._tokens(*A._paths(None, None, None))


def brute(rows):
    """Tokenise every row, compare all ends, list all links, count over rows."""
    a, b = Tokenizer.from_file(public.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    a.encode_special_tokens = True
    letters = A._letter_bytes()
    texts, count = {}, Counter()
    for _, text in rows:
        if not text:
            continue
        if text not in texts:
            ids = a.encode(" " + text, add_special_tokens=False).ids
            bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids]
            other = b.encode(text)
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in other]
            full = (" " + text).encode()
            groups = []
            if b"".join(bytes_a) == full and b"".join(bytes_b) == full:
                ends = lambda parts: [sum(map(len, parts[:n + 1])) for n in range(len(parts))]
                end_a, end_b = ends(bytes_a), ends(bytes_b)
                low = 0
                for cut in sorted(set(end_a) & set(end_b)):
                    groups.append(([i for i, e in zip(ids, end_a) if low < e <= cut], [i for i, e in zip(other, end_b) if low < e <= cut]))
                    low = cut
            texts[text] = groups
        count.update({(x, y) for p, q in texts[text] for x in p for y in q})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for id_, text in rows:
        groups = texts.get(text, []) if text else []
        links = [(x, y) for p, q in groups for x in p for y in q]
        line = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((id_, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return sorted(out, key=repr)


def rows():
    random.seed(4)
    words = ["the", "unbelievable", "tokenisation,", "Straße", "über", "niño", "12345", "don't", "foo_bar", "日本語", "x" * 90, "naïve", "<|endoftext|>", "</s>", "<0x41>", "🙂", "é", "“quoted”"]
    out = [(n, " ".join(random.choices(words, k=random.randint(1, 40)))) for n in range(120)]
    out += [(200 + n, out[3][1]) for n in range(60)]  # a group of copies
    out += [(300, None), (301, ""), (302, " "), (303, "  two  spaces  "), (304, "\n\n\ttab\r\n"), (305, "▁ mark"), (306, "a" * 5000), (307, "日本" * 700), (308, "\x00\x1c\x85​　 odd"),
            (309, "ﬁ ligature"), (3, "same id, other text"), (310, "a"), (311, " a"), (312, "Ⅷ ² ½ ٣ ३"), (313, "͸ unassigned"), (None, "no id")]
    return out


@pytest.mark.parametrize("block", [50, A.BLOCK_PAIRS])
def test_equals_brute_force(spark, block):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as id", "'d' as digest", "2 as n_a", "3 as block", "4 as copies").repartition(3)
    got = A.alignments(df, block_pairs=block)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(data)


def test_groups_with_many_links_are_counted_by_distinct_ids(both, monkeypatch):
    texts = [t.encode() for _, t in rows() if t]
    plain = A.Aligned(texts, *both).pairs()
    monkeypatch.setattr(A, "LISTED_LINKS", 0)
    assert all((x == y).all() for x, y in zip(plain, A.Aligned(texts, *both).pairs()))


def test_fast_paths_give_the_ids_of_the_tokenizers(both):
    a, b = both
    assert a.alike and b.by_word
    random.seed(9)
    letters = "abcdefghijABC  \n\t.,;'’“”…-_0123456789éñßÀøſłž*#<>|½²ª"
    for _ in range(400):
        text = "".join(random.choices(letters, k=random.randint(1, 120)))
        assert a.ids(" " + text) == a.whole(" " + text)
        assert b.ids(text) == b.model.encode(text), repr(text)


def test_empty_table(spark):
    assert A.alignments(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = A.alignments(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0, 0, "")]
