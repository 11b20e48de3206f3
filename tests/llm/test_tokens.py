import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.llm import tokens

ODD = ["It's a DON'T we'll 12345 “smart” naïve ÉCOLE ﬁ é ΑΣ Σ. <|endoftext|>x", None, "", "  ", "\t x　y", "a<|b", "plain text, it'D o'clock x'llama 99'9's", "ª º × ÷ µ ß ẞ İ 漢字 😀 \x00z \x85q", "_under-score ... !!! 'S 't're", "x" * 5000, "7" * 50, "a\x0bb\x0cc"]


def check(texts):
    enc = tokens.encoder()
    ids, sizes = enc.encode(pa.array(texts, pa.string()))
    at = 0
    for t, n in zip(texts, sizes.tolist()):
        assert ids[at : at + n].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids, t
        at += n
    assert at == len(ids)


def test_odd_texts():
    check(ODD)
    check(ODD[::-1] * 3)
    check([])
    check([None])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abzAZéÉß'stdlrevm019.,!-_ \n\t\x0b<|>×İ漢"), max_size=30), max_size=6))
def test_like_the_library(texts):
    check(texts)


def test_slices_keep_offsets():
    whole = pa.array(ODD, pa.string())
    enc = tokens.encoder()
    ids, sizes = enc.encode(whole.slice(6, 3))
    expected = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in ODD[6:9]]
    assert ids.tolist() == sum(expected, []) and sizes.tolist() == list(map(len, expected))


def test_words_of_nul_alone():
    check(["\x00", "\x00 a", "a \x00\x00 b", "\x00\x0b", "a\x00", "a\x00\x00 a", "\x00a\x00"])


def test_what_is_forgotten_is_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    monkeypatch.setattr(tokens, "CACHE_IDS", 150)
    enc = tokens.WordEncoder(tokens.default_path())
    for step in range(30):
        texts = [" ".join(f"{w} {w}{chr(97 + step % 26)}qz{chr(97 + k)}" for k, w in enumerate(["often", "used", "words"] * 4)), "x" * (15 + step % 3), "often 漢字漢字漢字" + "字" * (step % 4), ""]
        ids, sizes = enc.encode(pa.array(texts))
        expected = [enc.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == sum(expected, []) and sizes.tolist() == list(map(len, expected))
        assert enc.n_words <= 60 + 40


def test_words_in_use_are_not_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 100)
    enc = tokens.WordEncoder(tokens.default_path())
    often = ["house", "garden", "internationalisation"]
    learnt = []
    piece = enc._piece
    monkeypatch.setattr(enc, "_piece", lambda w: learnt.append(w) or piece(w))
    for step in range(20):
        enc.encode(pa.array([" ".join(often + [chr(97 + step) + "q" + chr(97 + k) for k in range(26)])]))
    assert [learnt.count(w) for w in often] == [1, 1, 1]


def test_equal_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(tokens, "hashed", lambda low, high: low & tokens.np.uint64(3))
    enc = tokens.WordEncoder(tokens.default_path())
    for text in ["one two three four five six seven", "seven six five four three two one", "one one eight"]:
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids
