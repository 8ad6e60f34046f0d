"""Token counts by the whole-token shortcut.

A sentencepiece BPE model without a piece that holds the space mark after another
character never merges across the start of a run of spaces, so a text's count is the sum
over its chunks, each a run of spaces and the characters that follow. When a model is
loaded, that property is checked on its vocabulary and its normaliser's own rules, and every
vocabulary string is encoded alone: those that give one token are counted directly. Other
chunks are merged by the library, and the counts of those of ordinary length are remembered.
A model without the property, or with a normaliser that changes texts, is applied to whole
texts; so are texts that hold the space mark itself.

Defined results: a null text counts as empty, with 0 tokens; a very long text is counted
whole; equal rows and null ids are kept as they are; an empty table gives an empty result;
other columns are not looked at.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import LONGEST, worker_cache

MARK = "▁"
CACHED = 400_000
SUB_BATCH = 1_000_000
SAMPLES = ("a  b", " a b ", "ﬁ Ａ x", "a\tb\nc")


def whole_tokens(model) -> set[str]:
    """The vocabulary strings, without their space mark, that encode alone as one token."""
    words = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    words = [w[1:] for w in words if w.startswith(MARK) and len(w) > 1]
    return {w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1}


def separable(model) -> bool:
    """Whether no piece joins a space mark to what stands before it, spaces start every text
    and nothing is normalised, by the model's own rules. If these can't be read, False."""
    try:
        from sentencepiece import sentencepiece_model_pb2 as form
    except ImportError:
        return False
    spec = form.ModelProto.FromString(model.serialized_model_proto())
    rules, kinds = spec.normalizer_spec, form.ModelProto.SentencePiece
    plain = not (rules.precompiled_charsmap or rules.normalization_rule_tsv or rules.remove_extra_whitespaces) and rules.add_dummy_prefix and rules.escape_whitespaces
    plain = plain and spec.trainer_spec.model_type == form.TrainerSpec.BPE and not spec.trainer_spec.treat_whitespace_as_suffix
    known = any(p.piece == MARK for p in spec.pieces)
    return plain and known and not any(p.type == kinds.USER_DEFINED or MARK in p.piece.lstrip(MARK) for p in spec.pieces)


def load_counter(path: str):
    """A function: list of texts -> list of counts."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    merged = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if not separable(model):
        return merged
    cache = dict.fromkeys(whole_tokens(model), 1)
    runs = re.compile(r" (?= *[^ ])(?<![ ] )")

    def chunks(text: str) -> list[str]:
        """Without the first space of each; the text's own start counts as one."""
        if "  " not in text and not text.startswith(" ") and not text.endswith(" "):
            return text.split(" ")
        return runs.split(" " + text)[1:] if text.strip(" ") else [text]

    def count(texts: list[str]) -> list[int]:
        out, cut = [0] * len(texts), []
        for i, text in enumerate(texts):
            if MARK in text:
                out[i] = merged([text])[0]
            elif text:
                cut.append((i, chunks(text)))
        new = list({w for _, words in cut for w in words if w not in cache})
        more = dict(zip(new, merged(new), strict=True))
        if len(cache) + len(new) <= CACHED:
            cache.update((w, n) for w, n in more.items() if len(w) <= LONGEST)
        for i, words in cut:
            out[i] = sum(cache[w] if w in cache else more[w] for w in words)
        return out

    return count


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit."""

    def run(batches):
        import public_tokenizers

        name = path or public_tokenizers.path("piece_bpe_32k.model")
        counter = worker_cache(("counts", name), lambda: load_counter(name))
        for batch in batches:
            counts, some, size, sizes = [], [], 0, []
            for x in batch.column(1):
                some.append(x.as_py() or "")
                size += len(some[-1])
                sizes.append(len(some[-1].encode()))
                if size >= SUB_BATCH:
                    counts += counter(some)
                    some, size = [], 0
            counts += counter(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], schema=SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
