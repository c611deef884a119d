"""Long texts are read to the end, in training and in prediction."""

import numpy as np

from almanac.llm import language


def test_every_piece_of_a_labelled_text_can_be_drawn(spark, monkeypatch):
    """With room for all, the pieces that are trained on are those of all texts, tails included."""
    seen = []
    monkeypatch.setattr(language, "train", lambda rows: seen.extend(rows))
    texts = [(" ".join(f"w{k}x{i}" for k in range(40 * i)) + " end", "en" if i % 2 else "de") for i in range(1, 30)]
    language.fit(spark.createDataFrame(texts, "text string, lang string"), pieces_bound=10**6)
    got = set(seen)
    learned = [all((p, lang) in got for p in language.pieces(t)) for t, lang in texts]
    assert got == {(p, lang) for (t, lang), own in zip(texts, learned, strict=True) if own for p in language.pieces(t)}
    assert sum(learned) >= 15
    assert all(b"".join(language.pieces(t)) == t.encode() for t, _ in texts)
    assert any(len(p) < 120 for p, _ in seen)


def test_sample_is_bounded(spark, monkeypatch):
    """As many pieces of each language are drawn, however long its texts are."""
    seen = []
    monkeypatch.setattr(language, "train", lambda rows: seen.extend(rows))
    texts = [(f"{i} " + "der Hund und die Katze " * 400, "de") for i in range(60)] + [(f"the cat and {i} dogs " * 30, "en") for i in range(60)]
    language.fit(spark.createDataFrame(texts, "text string, lang string"), pieces_bound=100)
    assert all(20 <= sum(own == lang for _, own in seen) <= 90 for lang in ("de", "en"))


def test_parts_give_what_the_whole_gives(monkeypatch):
    rng = np.random.default_rng(1)
    model = language.LanguageModel(["a", "b"], rng.normal(size=(language.BUCKETS, 2)), np.zeros(2), 1.0, 0.0)
    for length in (0, 1, 2, 3, 4, 5, 63, 64, 65, 66, 67, 500):
        data = bytes(rng.integers(97, 123, length, dtype=np.uint8))
        whole = language.sums(model, data)
        for part in (3, 4, 64):
            monkeypatch.setattr(language, "PART", part)
            total, n = language.sums(model, data)
            assert n == whole[1] and np.allclose(total, whole[0])
        monkeypatch.setattr(language, "PART", 1 << 16)
