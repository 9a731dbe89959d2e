"""Token ids of texts under the vocabularies of tokenizers' BPE models.

tiktoken joins any two neighbours whose bytes together are a token, lowest id first; a model joins the pairs it lists, in
order. The two agree where each listed pair is what joining by id ends with on the bytes of its token: then no other pair
can ever give that token. ``ranks`` proves this for every token before the vocabulary is used.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import numpy as np

IDS = np.dtype("<u4")
#: How byte-level vocabularies write bytes: printable ones as themselves, the others in order from 256 on.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: chr(b) for b in PRINTED} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
#: Fixed value: how byte-level tokenizers cut a text before merging.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def joined_by_rank(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, ...]:
    """The last two parts of ``token`` when its bytes are joined pair by pair, lowest rank first."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 40))
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts)


def ranks(model: dict, plain: Callable[[str], bytes]) -> dict[bytes, int]:
    """Bytes of each token -> id, proved fit for joining by id. ``plain`` turns a token as written into its bytes."""
    found = {plain(t): i for t, i in model["vocab"].items()}
    pairs = [(plain(a), plain(b)) for a, b in model["merges"]]
    order = [found[a + b] for a, b in pairs]
    if len(found) < len(model["vocab"]) or order != sorted(order) or any(joined_by_rank(a + b, found) != (a, b) for a, b in pairs):
        raise ValueError("merging by id does not give this vocabulary's merges")
    return found


def byte_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids (unsigned, 32 bit) as tokenizers' byte-level model at ``path`` gives them without added
    special tokens. Strings of special tokens in a text become their ids, as is that library's default."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    kind = told["pre_tokenizer"]
    if told["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    byte = {c: b for b, c in LETTERS.items()}
    coder = tiktoken.Encoding(
        path, pat_str=CUTS, mergeable_ranks=ranks(told["model"], lambda t: bytes(map(byte.__getitem__, t))),
        special_tokens={t["content"]: t["id"] for t in told["added_tokens"]})
    return lambda text: coder.encode_to_numpy(text, allowed_special="all").astype(IDS, copy=False)


#: Fixed value: the word parts of the vocabularies with word ends.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The same for texts of Latin-1 characters, whose letters and numbers can be listed.
LATIN_LETTERS, LATIN_NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN_PARTS = rf"[{LATIN_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{LATIN_NUMBERS}]|[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+"
#: How these vocabularies write the end of a word, and the byte that stands for it here.
WORD_END, END_BYTE = "</w>", b"\0"


def lower(text: str) -> str:
    """Lower case character by character, as the tokenizer does: a capital sigma has one lower form, wherever it stands."""
    return "".join(map(str.lower, text)) if "Σ" in text else text.lower()


def word_ranks(path: str) -> dict[bytes, int]:
    """Bytes of each token -> id for ``word_encoder``, proved once. Reading and proving the model takes far more memory than what
    comes of it, so this is done before tasks begin and not by each of them."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    if model["end_of_word_suffix"] != WORD_END:
        raise ValueError(f"{path} has no word ends")
    byte = {c: b for b, c in LETTERS.items()}

    def plain(token: str) -> bytes:
        ended = token.endswith(WORD_END)
        return bytes(map(byte.__getitem__, token[: -len(WORD_END)] if ended else token)) + END_BYTE * ended

    zero = LETTERS[END_BYTE[0]]
    told = {"vocab": {t: i for t, i in model["vocab"].items() if zero not in t}, "merges": [m for m in model["merges"] if zero not in m[0] + m[1]]}
    by_id = ranks(told, plain)
    by_id[END_BYTE] = max(by_id.values()) + 1  # never left alone: every byte has a token that ends a word
    return by_id


def word_encoder(path: str, by_id: dict[bytes, int] | None = None) -> Callable[[str], np.ndarray]:
    """Function from a text to its ids as tokenizers' model at ``path`` gives them without added special tokens: lower case,
    white space dropped, words ended by ``WORD_END``. ``by_id`` is what ``word_ranks`` gives for this path.

    The end of a word is one more byte here. Joining it to the letter before it comes first of all, since those tokens have
    the lowest ids; from there on the merges are the same. Texts with that byte, with the start of a special token, or with
    separators on which Python and the tokenizer disagree, are encoded by the library.
    """
    import regex
    import tiktoken
    from tokenizers import Tokenizer

    by_id = word_ranks(path) if by_id is None else by_id
    coder = tiktoken.Encoding(path, pat_str=r"[^\x00]+\x00", mergeable_ranks=by_id, special_tokens={})
    whole: list[Tokenizer] = []
    parts, latin, odd, mark = regex.compile(PARTS), re.compile(LATIN_PARTS), re.compile("<\\||[\0\x1c-\x1f]"), END_BYTE.decode()

    def encode(text: str) -> np.ndarray:
        if odd.search(text):
            if not whole:  # few tasks need it
                whole.append(Tokenizer.from_file(path))
            return np.asarray(whole[0].encode(text, add_special_tokens=False).ids, IDS)
        try:
            text.encode("latin-1")
            found = latin.findall(text.lower())  # no combining marks: nothing to normalise
        except UnicodeEncodeError:
            found = parts.findall(lower(unicodedata.normalize("NFC", text)))
        if not found:
            return np.zeros(0, IDS)
        found.append("")
        return coder.encode_to_numpy(mark.join(found)).astype(IDS, copy=False)

    return encode
