from collections import Counter

import pyarrow as pa

from podia.llm import langid


def test_counts_are_handed_on_before_they_grow(monkeypatch):
    """No batch has many more keys than MOST_KEYS, and the sums are those of one count."""
    monkeypatch.setattr(langid, "MOST_KEYS", 10)
    words = [f"w{chr(97 + i)}x{chr(97 + j)}" for i in range(9) for j in range(9)]
    texts = pa.RecordBatch.from_arrays([pa.array(["en"] * 27), pa.array([" ".join(words[i : i + 3]) for i in range(0, 81, 3)])], ["lang", "text"])
    for count, batches in ((langid._count_words, [texts, texts]), (langid._count_grams, list(langid._count_words([texts, texts])))):
        got, sizes = Counter(), []
        for b in count(iter(batches)):
            sizes.append(b.num_rows)
            for *key, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[tuple(key)] += n
        assert max(sizes) <= 40 and len(sizes) > 3
        if count is langid._count_words:
            assert sum(got.values()) == 2 * sum(len(langid.runs(t)) for t in texts.column(1).to_pylist())
    assert not list(langid._count_words(iter([])))[0].num_rows
