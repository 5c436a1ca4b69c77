"""A smaller table of remembered words changes no ids, and the pipeline asks for one."""

from __future__ import annotations

import corpus_pipeline
from underwright.llm import sentencepiece_codec as codec


def test_small_tables_give_the_same_ids_and_start_anew(monkeypatch):
    with open(codec.MODEL, "rb") as file:
        v = codec.vocabulary(file.read())
    texts = ["one two three four", "", "five six one two", "seven one"]
    small = codec.Words(v, 3)
    for text in texts:
        ids, count = small.encode([text])
        whole, n = codec.encode_texts(v, [text])
        assert ids.tolist() == whole.tolist() and count.tolist() == n.tolist() and len(small.number) <= 3
    asked = []
    monkeypatch.setattr(codec, "encode_documents", lambda docs, **k: asked.append(k["most_words"]))
    corpus_pipeline.encode(None, None, "")
    assert asked[0] < codec.MOST_WORDS
