"""Byte-pair encoding by dynamic programming over prefixes.

If a boundary between two tokens survives the merges of a text, the tokens left
of it are the encoding of the text left of it: no merge ever crossed it. So the
last token of every prefix decides the encoding of that prefix, and the last
token of a prefix is the one suffix that is a token and stays apart from the
last token of what precedes it. One walk over a text gives the encoding, and
with it the exact token count, of every prefix.
"""

import json

#: Entries a cache may hold before it is emptied; a cache only saves time.
CACHE_ENTRIES = 400_000


class PrefixBpe:
    """Encoder over symbols that are one character each.

    ``ranks`` gives the priority of a merge (smaller first, the leftmost on
    ties) by pair, or by the merged token if ``by_pair`` is false; ``tokens``
    are the texts that may be one token, apart from single symbols.
    """

    def __init__(self, ranks, tokens, by_pair):
        self._ranks, self._by_pair = ranks, by_pair
        self._whole = {t: None for t in tokens if len(t) > 1}
        self._apart = {}
        longest = {}  # by the last three characters, or both of tokens of two
        for token in self._whole:
            longest[token[-3:]] = max(longest.get(token[-3:], 1), len(token))
        self._longest = longest

    def merged(self, symbols):
        """The encoding of a short text by plain merging."""
        parts, get = list(symbols), self._ranks.get
        while True:
            pairs = zip(parts, parts[1:])
            found = map(get, pairs) if self._by_pair else [get(a + b) for a, b in pairs]
            found = [(r, i) for i, r in enumerate(found) if r is not None]
            if not found:
                return parts
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _is_token(self, text):
        whole = self._whole[text] = len(self.merged(text)) == 1
        return whole

    def _stay_apart(self, left, right):
        if len(self._apart) > CACHE_ENTRIES:
            self._apart.clear()
        parts = self.merged(left + right)
        apart = self._apart[left, right] = len(parts) == 2 and parts[0] == left
        return apart

    def last_tokens(self, text, last=None):
        """The last token of every prefix, the empty one first.

        ``last`` may have those of a prefix of ``text``; it is extended.
        """
        last = last or [""]
        whole, apart, longest = self._whole, self._apart, self._longest
        for end in range(len(last), len(text) + 1):
            tail = text[max(0, end - 3) : end]
            most = longest.get(tail) or longest.get(tail[-2:], 1)
            for start in range(max(0, end - most), end):
                piece = text[start:end]
                if end - start > 1:
                    known = whole.get(piece, False)
                    if known is False or (known is None and not self._is_token(piece)):
                        continue
                if start:
                    fits = apart.get((last[start], piece))
                    if fits is None:
                        fits = self._stay_apart(last[start], piece)
                    if not fits:
                        continue
                last.append(piece)
                break
        return last

    def steps(self, texts):
        """(text, last tokens of its prefixes, characters shared with the text before) in
        text order, shared prefixes once.

        The list of tokens is reused: take what is needed before going on.
        """
        before, last = "", [""]
        for text in sorted(texts):
            same = next((i for i, (a, b) in enumerate(zip(before, text)) if a != b), None)
            same = min(len(before), len(text)) if same is None else same
            del last[1 + same :]
            yield text, self.last_tokens(text, last), same
            before = text

    def walk(self, texts):
        """(text, last tokens of its prefixes), as of ``steps``."""
        return ((text, last) for text, last, _ in self.steps(texts))

    @staticmethod
    def split(text, last):
        """The tokens of a text, given the last tokens of its prefixes."""
        end, out = len(text), []
        while end:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def tokens(self, text):
        return self.split(text, self.last_tokens(text))


def from_sentencepiece(model_file):
    """(encoder, weight): ``weight(token)`` is the number of ids of a token.

    Pieces merge by score. What is no piece is spelled in bytes, one id each.
    """
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    ids = [i for i in range(model.get_piece_size()) if not any(f(i) for f in special)]
    scores = {model.id_to_piece(i): -model.get_score(i) for i in ids}
    if model.normalize("AÅÅ   x") != "▁AÅÅ▁▁ x":
        raise ValueError("only models that leave the text as it is are supported")
    if any("▁" in piece.lstrip("▁") or "\n" in piece for piece in scores):
        raise ValueError("only models whose pieces end before a space are supported")

    def weight(token):
        return 1 if token in scores else len(token.encode())

    return PrefixBpe(scores, scores, by_pair=False), weight


def byte_symbols():
    """The character that stands for each byte in byte-level vocabularies.

    Printable bytes stand for themselves, the others for the characters from
    256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


#: Added to a symbol that ends a word; far from the symbols themselves.
WORD_END = 0xE000


def from_word_vocabulary(json_file):
    """(encoder, ids, symbols) of a byte-level vocabulary with word ends.

    ``symbols(word)`` spells a word for the encoder, ``ids`` has the id by token.
    """
    with open(json_file, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, spelled = model["end_of_word_suffix"], byte_symbols()

    def symbols_of(token):
        if token.endswith(suffix):
            token = token.removesuffix(suffix)
            return token[:-1] + chr(WORD_END + ord(token[-1])) if token else ""
        return token

    ids = {symbols_of(token): i for token, i in model["vocab"].items()}
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    ranks = {(symbols_of(a), symbols_of(b)): i for i, (a, b) in enumerate(pairs)}

    def symbols(word):
        text = "".join(map(spelled.__getitem__, word.encode()))
        return text[:-1] + chr(WORD_END + ord(text[-1]))

    return PrefixBpe(ranks, ids, by_pair=True), ids, symbols
