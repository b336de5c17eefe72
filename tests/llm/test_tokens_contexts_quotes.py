"""Cases of the second review of the operators."""

import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagelens.llm import chat_threads, pitman_yor, rans


def test_token_files_equal_the_library(spark):
    """Added tokens and code points that are letters only in newer Unicode versions."""
    texts = ["foo <|endoftext|> bar", "a<|endoftext|><|endoftext|>b  c \n d", "x՘y ֋ ౜z ՘՘ 1՘", "a ౜  b֋\n c", "it's  We'll　 x <|endoftext|",
             "Ᲊa Ɤ \U00010d50b \U000105c0 \U0001e5d0"]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: tok.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert 50256 in want[0]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rans.token_files(docs, P.path("byte_bpe_50k.json"), P.PATTERN, special=True).collect()}
    assert got == want


@pytest.mark.parametrize("special", [True, False])
def test_units_of_random_texts_equal_the_library(special):
    """Blanks, tabs, wide blanks, added tokens, a long text; also when a token's bytes are misjudged."""
    rng, pieces = random.Random(3), [*" \n\t　 ab'1,.é中ౝ😀s", "<|endoftext|>", "  "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", " ", " x" * 50_000, "é" * 50_000]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = not special
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts], pa.binary())], ["doc_id", "text"])
    out = [x for b in rans._tokenize(P.path("byte_bpe_50k.json"), 2, special, "<u2")([batch]) for x in b.column("ids").to_pylist()]
    assert [np.frombuffer(x, "<u2").tolist() for x in out] == [tok.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    # wrong widths: no group fits, every unit is encoded on its own
    flat, counts, place = rans.encode_units(tok, np.ones(tok.get_vocab_size(), np.int64), ["a b"], pa.array(["word", "é,"], pa.large_string()))
    ends = np.cumsum(counts)
    assert [flat[ends[i] - counts[i]:ends[i]].tolist() for i in place] == [tok.encode(t, add_special_tokens=False).ids for t in ["a b", " word", " é,"]]


def test_ids_are_counted_over_whole_batches():
    """Also over slices; a worker reads the tokenizer once."""
    lists = [[7, 1, 1], [2], [], [299, 2]]
    batch = pa.RecordBatch.from_arrays([pa.array([np.array(x, "<u2").tobytes() for x in lists], pa.binary())], ["ids"])
    for part, want in ((batch, {1: 2, 2: 2, 7: 1, 299: 1}), (batch.slice(1, 3), {2: 2, 299: 1}), (batch.slice(2, 1), {}), (batch.slice(0, 0), {})):
        out, = rans._count(300)([part])
        assert dict(zip(out.column("id").to_pylist(), out.column("n").to_pylist())) == want
    path = P.path("byte_bpe_50k.json")
    assert rans.library(path, True) is rans.library(path, True) is not rans.library(path, False)


def test_white_space_before_a_blank_is_found_in_any_script():
    odd = [chr(c) for c in range(0x3001) if chr(c).isspace() and rans.U.re.match(r"\s", chr(c))]
    texts = [f"a b{c} d" for c in odd] + [f"a{c}b d" for c in odd] + ["", "a b", "\u180e b", "\u200b b"]
    plain, *_ = rans.cut(texts, lambda t: False)
    assert [t for t in texts if t in plain and t] == [f"a b{c} d" for c in odd]


def test_pitman_yor_learns_every_context(spark):
    """600 words, each always followed by its own partner: far more contexts than any fixed number of restaurants."""
    train = [i for i in range(2000) if not pitman_yor.held_out(i)][:100]
    held = [i for i in range(2000, 20000) if pitman_yor.held_out(i)]
    rows = [(i, " ".join(f"x{k} y{k} z" for k in range(k0, 600, 7))) for k0, i in zip([*range(7)] * 12, train)]
    rows += [(held[2 * k], f"x{k} y{k}") for k in range(600)] + [(held[2 * k + 1], f"x{k} y{(k + 1) % 600}") for k in range(600)]
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert sum(got[held[2 * k]] > got[held[2 * k + 1]] + 1 for k in range(600)) == 600
    # without training documents every word is unknown
    assert [r.n_known for r in pitman_yor.score_documents(spark.createDataFrame([(held[0], "a b")], "doc_id long, text string")).collect()] == [0]


def test_quotes_are_linked_by_whole_passages(spark):
    msgs = [(0, "Start here\nThanks."), (1, "other"), (2, "My answer\n\nThanks."), (3, "> My answer\n>\n> Thanks.\nok"),
            (4, "> My answer\n> edited\n> Thanks.\nhm"),  # no message has it as a whole: lines still count
            (5, ">> start here\n> ok"), (6, "> ok\n\n> hm\n> not there")]
    frame = spark.createDataFrame([("e", t, "a", x) for t, x in msgs], "conv_id string, turn long, role string, text string")
    got = {r.turn: (r.reply_to, r.root_turn, r.depth, r.n_quoted, r.n_linked) for r in chat_threads.quote_links(frame).collect()}
    assert got == {0: (None, 0, 0, 0, 0), 1: (None, 1, 0, 0, 0), 2: (None, 2, 0, 0, 0), 3: (2, 2, 1, 2, 2), 4: (2, 2, 1, 3, 2),
                   5: (3, 2, 2, 2, 2), 6: (4, 2, 2, 3, 2)}
