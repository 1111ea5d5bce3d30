import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from podia.llm import langid, licences, unigram
from podia.llm.queries import PIECES

from .cases import TEXTS, documents, empty

WORD = {"xx": "alpha beta gamma delta epsilon", "yy": "uno dos tres cuatro cinco", "zz": "йод кот дом лес"}


def corpus(n=300, seed=0):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORD[lang].split()) for _ in range(rng.randint(1, 20))), lang, "s") for i in range(n) for lang in [rng.choice(list(WORD))]]


def test_language_of_held_out_documents(spark):
    docs = documents(spark, corpus()).withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.fit(docs.filter(~F.col("held_out")))
    got = langid.identify(docs, model).filter("held_out").collect()
    assert len(got) > 40
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_back_off_to_grams(spark):
    model = langid.fit(documents(spark, corpus()))
    assert "alphabet" not in model.words
    assert model.predict("alphabet")[0] == "xx" and model.predict("коты")[0] == "zz"
    assert model.of_unseen("€").tolist() == [0.0] * 3
    long = "alphabet " * 300_000
    assert model.predict(long)[0] == "xx"


def test_und_and_empty_tables(spark):
    model = langid.fit(documents(spark, corpus()))
    docs = documents(spark)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and (letters or r.score == 0)
    assert {r.doc_id for r in langid.accept(docs, model).collect()} == {r.doc_id for r in got if r.lang_pred != "und"}
    assert langid.accept(docs, model).columns == docs.columns
    one = langid.accept(docs, model, languages=model.langs[:1], pred_col="told", score_col="sure").collect()
    assert {r.told for r in one} == {model.langs[0]} and 0 < len(one) < len(got)
    assert {r.doc_id for r in langid.accept(docs, model, least=0.99).collect()} == {r.doc_id for r in got if r.lang_pred != "und" and r.score >= 0.99}
    clash = docs.withColumnsRenamed({"id": "lang_pred", "fp": "score"})
    assert langid.accept(clash, model).columns == clash.columns and langid.accept(clash, model).filter("lang_pred = 7").count() > 0
    assert langid.accept(docs, model, languages=[]).count() == 0
    nothing = langid.fit(empty(spark))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


def brute_language(rows, text):
    """The prediction from counts of all rows, written anew from the definition: (language, share of the likelihood)."""
    langs = sorted({lang for _, _, lang, _ in rows})
    words = {x: Counter() for x in langs}
    for _, t, lang, _ in rows:
        words[lang].update(re.findall(r"[^\W\d_]+", t.lower()))
    pieces = lambda w, n: [w] if n == 0 else [f"<{w}>"[i : i + n] for i in range(len(w) + 3 - n)] if n > 1 else list(w)

    def scores(n):
        counts = {x: Counter() for x in langs}
        for x in langs:
            for w, k in words[x].items():
                for g in pieces(w, n):
                    counts[x][g] += k
        total = {x: max(1, sum(counts[x].values())) for x in langs}
        top, every = max(total.values()), set().union(*counts.values())
        return {g: {x: math.log((counts[x][g] * top / total[x] + 0.5) / (top + 0.5 * len(every))) for x in langs} for g in every}

    tables = [scores(n) for n in range(6)]
    total = {x: math.log(sum(r[2] == x for r in rows) / len(rows)) for x in langs}
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        for n in (0, 5, 4, 3, 2, 1):
            known = [tables[n][g] for g in pieces(w, n) if g in tables[n]]
            if known:
                for x in langs:
                    total[x] += sum(k[x] for k in known) / len(known)
                break
    best = max(langs, key=lambda x: total[x])
    return best, 1 / sum(math.exp(v - total[best]) for v in total.values())


def test_predictions_match_brute_force(spark):
    rng = random.Random(11)
    rows = corpus(200)
    model = langid.fit(documents(spark, rows))
    letters = "aeinorsu йкот"
    texts = [r[1] for r in corpus(30, 5)] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) + "x" for _ in range(60)]
    docs = documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    for r in langid.identify(docs, model).collect():
        lang, share = brute_language(rows, r.text)
        assert r.score == pytest.approx(share) and (r.lang_pred == lang or share < 0.51)


def test_sample_is_bounded(spark):
    docs = documents(spark, corpus(2000))
    model = langid.fit(docs, sample_rows=100)
    assert model.predict("uno dos")[0] == "yy"


DEFAULT = licences.Scanner(licences.NOTICES, licences.BASE)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in licences.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licence_base_by_brute_force(spark):
    rng = random.Random(4)
    parts = ["MIT", "License", "apache", "general", "public", "é", "x1", "GNU", "mit license", "-", "\n", ". "]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "en", "a") for i in range(200)] + TEXTS
    texts = [r[1] for r in rows]
    got = sorted(((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licences.licence_scan(documents(spark, rows)).collect()), key=str)
    assert got == sorted((brute_base(t) for t in texts), key=str)
    assert licences.licence_scan(empty(spark)).count() == 0


def edits(rng, text, n):
    for _ in range(n):
        i = rng.randrange(1, len(text) - 1)
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "q" + text[i + 1 :]])
    return text


def test_licence_errors_within_bounds_are_found():
    rng = random.Random(6)
    for notice, label in licences.NOTICES.items():
        most = max(1, len(notice) // licences.CHARS_PER_ERROR)
        for n in range(most + 1):
            text = f"Some text. {edits(rng, notice, n)} and more"
            found = DEFAULT.scan(text)
            assert label in found["labels"].split(","), (notice, text)
            assert 0 < found["score"] <= 1
            assert all(text[s["start"] : s["stop"]] in text and s["edits"] <= most for s in found["spans"])
    assert DEFAULT.scan("nothing of the kind is written here at all")["labels"] == ""


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def near_spans(line, notice, most):
    """(edits, start, stop) of every run of whole words that is near enough."""
    starts = [m.span() for m in re.finditer("[^ ]+", line)]
    out = []
    for i, (lo, _) in enumerate(starts):
        for _, hi in starts[i:]:
            if abs(hi - lo - len(notice)) <= most and (d := distance(line[lo:hi], notice)) <= most:
                out.append((d, lo, hi))
    return out


def test_every_notice_is_found_whatever_stands_before_it():
    rng = random.Random(12)
    notice, most = "released under the mit license", 3
    own = licences.Scanner({notice: "mit"}, {})
    lines = ["released under the mitt license foo released under the mit license", "released under the mit license foo released under the mitt license", "the mit licence released under the mit license under the mit"]
    words = notice.split()
    for _ in range(60):
        parts = [rng.choice([notice, edits(rng, notice, rng.randint(0, 4)), rng.choice(words), "foo", edits(rng, rng.choice(words) + "xx", 1)]) for _ in range(rng.randint(1, 6))]
        lines.append(" ".join(" ".join(parts).split()))
    for line in lines:
        every = near_spans(line, notice, most)
        found = own.matches(line)
        assert all(distance(line[s:e], notice) == d for _, s, e, d in found), line
        assert all(a[2] <= b[1] for a, b in zip(found, found[1:], strict=False)), line
        for d, lo, hi in every:  # nothing near is left over, and what stands in its way is no farther
            assert any(s < hi and lo < e and f <= d for _, s, e, f in found), (line, line[lo:hi])
    assert len(own.matches(lines[0])) == len(own.matches(lines[1])) == 2


def test_long_texts_take_time_in_proportion():
    for text in ("released under the mit license. " * 32_000, "general public license " * 43_000, "x" * 1_000_000, "released under the mlt licence or " * 20_000):
        began = time.perf_counter()
        found = DEFAULT.scan(text)
        assert time.perf_counter() - began < 8
        assert found["n_words"] == len(text.split())
    assert len(DEFAULT.scan("released under the mit license. " * 3000)["spans"]) == 3000


def test_own_notices_and_phrases(spark):
    docs = documents(spark, [(1, "This is OUR  Own-notise, really. plain phrase", "en", "a"), (2, None, "en", "a")])
    got = {r.doc_id: r for r in licences.licence_scan(docs, notices={"our own notice": "own", "!!": "none"}, phrases={"Plain Phrase": "plain"}).collect()}
    assert (got[1].labels, got[1].n_base, got[1].first_word, got[1].spans[0].edits) == ("own,plain", 1, 6, 1)
    assert (got[2].labels, got[2].score) == ("", 0.0)
    assert {r.labels for r in licences.licence_scan(docs, notices={}, phrases={}).collect()} == {""}


def test_spans_are_places_of_the_text():
    text = "Ünï. © ALL rights—reserved!"
    (span,) = DEFAULT.scan(text)["spans"]
    assert text[span["start"] : span["stop"]] == "ALL rights—reserved"


def brute_viterbi(vocab, pieces, text):
    best = [(0.0, [])] + [None] * len(text)
    for i in range(len(text)):
        if best[i] is None:
            continue
        for j in range(i + 1, min(len(text), i + 16) + 1):
            k = pieces.get(text[i:j])
            if k is not None and (best[j] is None or best[i][0] + vocab.scores[k] > best[j][0] + 1e-12):
                best[j] = (best[i][0] + vocab.scores[k], best[i][1] + [k])
        if text[i] not in pieces:
            own = best[i][0] + vocab.unknown
            if best[i + 1] is None or own > best[i + 1][0]:
                best[i + 1] = (own, best[i][1] + [int(vocab.byte_ids[b]) for b in text[i].encode()])
    return best[-1]


@pytest.fixture(scope="module")
def vocab():
    return unigram.load_vocabulary(PIECES, zipf=True).fresh()


def test_ranks_are_no_scores_unless_asked_for(spark):
    with pytest.raises(ValueError, match="no unigram model"):
        unigram.encode(documents(spark), PIECES)


def test_viterbi_by_brute_force(vocab):
    pieces = {vocab.surface[i].decode().replace(" ", "▁"): i for i in np.nonzero(np.isfinite(vocab.scores))[0].tolist()}
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice("the an  ing\nтé日😀\x01") for _ in range(rng.randint(1, 25)))
        ids, ends = vocab.encode([text])
        whole = ("▁" + text.replace(" ", "▁"))
        score = sum(vocab.scores[i] for i in ids if np.isfinite(vocab.scores[i]))
        want, path = brute_viterbi(vocab, pieces, whole)
        unknown = sum(1 for c in whole if c not in pieces)
        assert score + unknown * vocab.unknown == pytest.approx(want) and ends[-1] == len(ids)


def test_agrees_with_the_tokenizers_library(vocab):
    from tokenizers import Tokenizer, models

    names = [s.decode("latin1") if len(s) == 1 and i in set(vocab.byte_ids.tolist()) else s.decode().replace(" ", "▁") for i, s in enumerate(vocab.surface)]
    other = Tokenizer(models.Unigram([(n if np.isfinite(vocab.scores[i]) else f"<{i}>", float(vocab.scores[i]) if np.isfinite(vocab.scores[i]) else -1e6) for i, n in enumerate(names)], 0, False))
    for word in "▁the ▁encoding ▁of ▁ordinary ▁words ▁and ▁unfamiliaroneslikethis".split():
        mine, theirs = vocab.viterbi([word.encode()])[0], other.encode(word).ids
        assert vocab.scores[mine].sum() == pytest.approx(vocab.scores[theirs].sum())


def test_double_array():
    pieces = [b"a", b"ab", b"abc", b"b", "é".encode(), b"\xff"]
    base, check, value = unigram.double_array(pieces)
    for i, p in enumerate(pieces):
        state = 0
        for c in p:
            to = base[state] + c + 1
            assert check[to] == state
            state = to
        assert value[state] == i
    assert (value >= 0).sum() == len(pieces)


def test_round_trip(spark):
    docs = documents(spark)
    out = unigram.decode(unigram.encode(docs, PIECES, zipf=True), PIECES)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    got = out.collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert (r.ids == []) == (not r.text)
    assert unigram.encode(empty(spark), PIECES, zipf=True).count() == 0


def test_memory_of_units_is_bounded(vocab, monkeypatch):
    monkeypatch.setattr(unigram, "REMEMBER", 50)
    own = vocab.fresh()
    texts = [f"word{i} other{i * 7}" for i in range(200)]
    for at in range(0, 200, 10):
        ids, ends = own.encode(texts[at : at + 10])
        assert [own.decode(x.tolist()) for x in np.split(ids, ends[:-1])] == texts[at : at + 10]
        assert len(own.seen) <= 50


def test_rare_languages_are_learned_and_draw_no_others(spark):
    rng = random.Random(2)
    rows = [(i, t, lang, s) for i, t, lang, s in corpus(3000) if lang != "zz"]
    rows += [(10_000 + i, " ".join(rng.choice(WORD["zz"].split()) for _ in range(10)), "zz", "s") for i in range(6)]
    rows += [(20_000 + i, "rari tantum nantes", "qq", "s") for i in range(2)] + [(30_000, "12 34", "no", "s")]
    model = langid.fit(documents(spark, rows), sample_rows=120)
    assert model.langs == ["qq", "xx", "yy", "zz"]
    assert model.predict("лес дом")[0] == "zz" and model.predict("nantes rari")[0] == "qq"
    assert model.predict("uno dos")[0] == "yy" and model.predict("alpha betas")[0] == "xx"
    lacking = [model.word_scores[model.words["alpha"], model.langs.index(x)] for x in ("qq", "yy", "zz")]
    assert lacking == pytest.approx(lacking[:1] * 3)
    assert sum(langid.quotas({"a": 3, "b": 10**9, "c": 10**6}, 1000).values()) == pytest.approx(1000)


def test_rows_without_an_id_are_sampled_one_by_one(spark):
    model = langid.fit(documents(spark, [(None, *r[1:]) for r in corpus(900)]), sample_rows=300)
    assert model.langs == sorted(WORD) and model.predict("uno dos")[0] == "yy"


def test_every_letter_of_a_long_run_counts(spark):
    for n in (1, 63, 64, 65, 124, 125, 500):
        word = "".join(chr(0x3042 + i % 80) for i in range(n))
        parts = langid.runs(word)
        assert parts[0] + "".join(p[langid.OVERLAP :] for p in parts[1:]) == word and all(0 < len(p) <= 64 for p in parts)
    rows = [(i, ("abcde" if i % 2 else "vwxyz") * 40, "xx" if i % 2 else "yy", "s") for i in range(20)]
    model = langid.fit(documents(spark, rows))
    assert model.langs == ["xx", "yy"]
    assert model.predict("abcde" * 10 + "vwxyz" * 60)[0] == "yy"


def test_unseen_words_of_a_text_are_scored_together(spark, monkeypatch):
    """Scores are read a few times a text, however many words are unseen, also when a worker forgets; each word gets the mean of its own n-grams."""
    model = langid.fit(documents(spark, corpus()))
    words = [f"{a}{b}{c}" for a in ("alp", "cua", "йо", "q") for b in "aeiouктл" for c in ("ta", "tro", "м", "zzz")]
    assert not set(words) & set(model.words)
    for w in words:
        n = next((n for n in range(langid.LONGEST, 0, -1) if any(g in model.grams[n] for g in langid.grams(w, n))), None)
        mean = model.gram_scores[n][[model.grams[n][g] for g in langid.grams(w, n) if g in model.grams[n]]].mean(axis=0) if n else np.zeros(len(model.langs))
        assert model.of_unseen(w).tolist() == mean.tolist()
    want = [model.predict(" ".join(words[i:] + words[:i])) for i in range(0, len(words), 10)]
    again = langid.Model(model.langs, model.prior, model.words, model.word_scores, model.grams, model.gram_scores)
    calls, scored = [], langid.Model.of_all_unseen
    monkeypatch.setattr(langid, "REMEMBER", 40)
    monkeypatch.setattr(langid.Model, "of_all_unseen", lambda self, new: calls.append(new) or scored(self, new))
    got = [again.predict(" ".join(words[i:] + words[:i])) for i in range(0, len(words), 10)]
    assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    assert 0 < len(calls) <= len(got) * -(-len(words) // 10) and len(again.places) <= len(again.words) + 40
