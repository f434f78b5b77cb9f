"""What a task of the tokenizer remembers."""

import gc

import public_tokenizers

from tracewell.llm import bpe


def test_remembered_ids_are_no_work_for_the_collector():
    """Hundreds of thousands of remembered words are nothing that the garbage collector walks through."""
    coder = bpe.Encoder(bpe.vocabulary(public_tokenizers.path("word_bpe_49k.json")))
    text = " ".join(f"Wörter{i} a{i:x}b$$$" for i in range(2000))
    ids = coder.encode(text)
    gc.collect()
    kept = [*coder.words.young.values(), *coder.parts.young.values()]
    assert len(coder.words.young) == 4000 and not any(gc.is_tracked(x) for x in kept)
    assert coder.encode(text) == ids and ids == [i for w in text.split() for i in coder.encode(w)]
