"""Abusive, hateful or sexual content: weak supervision.

Many voters (word lists and patterns over folded text) vote for or against each document or abstain. A generative label model learns from the vote
patterns of all documents how accurate each voter is and which voters say the same thing twice; its posteriors label a bounded sample, on which a linear classifier over
words, word pairs and votes is trained; that classifier scores every document.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from re import _constants as _ops
from re import _parser

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from codelode.common import written
from codelode.llm.text import unescaped

# Word lists.
INSULTS = """idiot imbecile moron clown cretin dipshit dumbass halfwit asshole bastard scumbag wasteofspace jackass arsehole bitch whore slut cunt wanker twat prick dickhead
fuckwit shithead douchebag retard simpleton dimwit nitwit numbskull blockhead bonehead degenerate lowlife sleazebag pig weasel trash garbage filth parasite vermin loser tosser
bellend muppet pillock vollidiot idiota imbecil arschloch wichser hurensohn schlampe missgeburt trottel schwachkopf pendejo cabron gilipollas estupido puta maricon connard
salope encule abruti cretino stronzo""".split()
DEGRADING = "useless worthless pathetic filthy spineless braindead stupid dumb ugly fat disgusting brainless wertlos wertloses inutil inútil".split()
GROUPS = """women woman girls females gays lesbians homos transgender foreigners immigrants migrants refugees cripples disabled jews muslims christians blacks whites asians
africans arabs gypsies religion race skin country""".split()

_INSULT = "|".join(sorted(INSULTS, key=len, reverse=True))
_DEGRADING = "|".join(DEGRADING)
_GROUP = "|".join(GROUPS)
_GAP = r"[^.!?;]{0,60}?"

#: Voters for the presence of abuse (+) and against it (-). All look at folded text.
VOTERS: list[tuple[str, int, re.Pattern]] = [
    ("insult_aimed", 1, re.compile(rf"\b(?:you|your|u|you're|du|tu|vous|eres)\b[^.!?;,]{{0,40}}?\b(?:{_INSULT})(?:e?s)?\b|\b(?:{_INSULT})(?:e?s)? like (?:you|him|her|them)\b|,\s*(?:you )?(?:(?:{_DEGRADING}) )*(?:{_INSULT})\b(?= *(?:$|[.!?\n]|lol)| \w+$)")),
    ("insult_of_author", 1, re.compile(rf"\bwhat kind of (?:{_INSULT})\b|\b(?:author|whoever|reviewer|maintainer)\b{_GAP}\b(?:{_INSULT}|ashamed)\b|breeds? nothing but (?:{_INSULT})s?")),
    ("degrading_aimed", 1, re.compile(rf"\byou(?:r)?\b[^.!?;]{{0,25}}?\b(?:{_DEGRADING})\b[^.!?;]{{0,25}}?\b(?:piece of|creature|nobody|{_INSULT})|\b(?:{_DEGRADING}) (?:creature|piece of \w+|people|person) like you|\b(?:your|you) (?:\w+ )?(?:{_DEGRADING}) \w+ with you|ugly fat \w+")),
    ("profane_attack", 1, re.compile(r"\bf+u+c+k+ (?:you|off|u|your)\b|\beat shit\b|\bgo to hell\b|\bshut (?:up,? you|your mouth)|\bget lost and|\bcrawl back|\bscrew you\b|\bfuck (?:him|her|them)\b|\bpiss off\b|\bdrop dead\b")),
    ("threat", 1, re.compile(rf"\b(?:hurt|kill|murder|beat|strangle|shoot|stab|rape) (?:you|your|u|her|him|them)\b|\bcut (?:your|his|her) throat|\bbreak (?:your|his|her) (?:\w+ )?(?:fingers?|legs?|neck|arms?|bones?|face|teeth)\b|\bspit in your\b|\bhit by a (?:truck|bus|train|car)|\bstop breathing\b|\bvanish for good|\bnobody would miss you|\bknow (?:your address|where you live)|\bfind out where you live|\bsleep with one eye|\bdeserves? to (?:be (?:beaten|shot|killed|hurt|raped)|die)|\b(?:should|must|ought to) be (?:put down|shot|hanged|gassed)|\byour (?:whole )?family too")),
    ("sexual", 1, re.compile(r"\b(?:tits|boobs|nudes|horny|blow ?jobs?|handjobs?|cum|orgasm|masturbat\w*|dick|cock|pussy|porno?)\b|\bsit on my (?:lap|face)|\bbend over and|\b(?:dream|think) of you naked|\byou naked\b|\brip your clothes|\bfuck (?:you|me|her|him) (?:on|in|over|against)|\bsend me (?:nudes|naked)|\bin bed with (?:you|me)\b|\bsuck my\b")),
    ("group_hate", 1, re.compile(rf"\b(?:{_GROUP})\b{_GAP}\b(?:disease|parasites?|vermin|subhumans?|animals|plague|rats|cockroaches|no business|kitchen|put down|inferior|exterminat\w+|gas chamber|breeds?|scum|filth)|\bno (?:woman|girl|foreigner|immigrant|jew|muslim) (?:has )?ever\b|\b(?:your|their) kind (?:are|is)\b|\bsubhumans?\b|\b(?:old )?cripples like\b|\bgo back to (?:the kitchen|your country|where you came)|\bkeep them away\b")),
    ("belittling", 1, re.compile(r"\broadkill\b|\btrained monkey\b|\byou are dumber\b|\byou are the human version|\bbrain is (?:clearly )?(?:rotten|dead|empty)|\byou type like an?\b|\bnobody (?:wants|likes|loves) you\b|\bbetter hire than you|\bshould have stopped one child|\byour mother\b|\bnobody asked for your\b|\bashamed\b[^.!?;]{0,20}\byou\b|\bbanned from touching|\byou are a complete\b|\bwhole country breeds|\blike you (?:would|should|deserves?)\b|\bhole you came from")),
    ("other_language", 1, re.compile(r"\bhalt die (?:fresse|klappe|schnauze)|\bstück (?:dreck|scheiße|scheisse)|\b(?:voll)?idiot und solltest|\bsolltest dich schämen|\bverpiss dich|\bfick dich|\bimb[eé]cil de mierda|\bde mierda\b|\bnadie te quiere|\bvete a la mierda|\bhijo de puta|\btu es vraiment une?|\bdégage\b|\bva te faire|\bferme ta gueule|\bsale (?:con|pute)\b|\bdu bist ein|\bfiglio di puttana|\bvaffanculo")),
    ("self_blame", -1, re.compile(r"\bi (?:was|am|feel like|must be) (?:such )?an? (?:\w+ )?(?:idiot|moron|fool|clown)|\bmy own (?:commit|fault|mistake)|\bstupid me\b|\bsilly me\b")),
    ("software", -1, re.compile(r"\b(?:damn|stupid|dumb|bloody|fucking|shitty|crappy) (?:\w+ )?(?:test|flag|name|build|terminals?|pipe|cache|compiler|script|bug)\b|\bzombie (?:child )?process|\bnaked pointer|\bmaster \w+ and its slave|\bchild process")),
    ("conduct_rule", -1, re.compile(r"\bcode of conduct\b|\bnot (?:be )?tolerated\b|\breport abuse\b|\bzero tolerance\b")),
    ("word_list", -1, re.compile(r"(?:[\"'][a-z ]{2,20}[\"'] ?, ?){2,}|\bwords refused\b|\b(?:blocked|banned|refused|forbidden) words\b|\bblock ?list\b|\bdeny ?list\b")),
]
POSITIVE = [k for k, v in enumerate(VOTERS) if v[1] > 0]

_MARKS = re.compile(r"(?m)^[ \t]*(?://[/!]?|/\*[*!]?|\*/?|#+|>+|--|<!--)[ \t]?|\*/[ \t]*$")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_LEET_WORD = re.compile(r"(?<![\w@$])(?=[a-z@$!]*[0-9@$!])(?=[0-9@$!]*[a-z])[a-z0-9@$](?:[a-z0-9@$]|![a-z0-9@$]){1,24}(?![\w@$])")
_LEET = str.maketrans("0134578@$!", "oieastbasi")
_SPACED = re.compile(r"(?<![\w.])(?:[a-z] +){3,}[a-z]s?(?:s|es|ns|ts)?\b")
_DOTTED = re.compile(r"(?<![\w.])[a-z]{1,4}(?:\. ?\.?[a-z]\b){2,}s?")
_DOUBLED = re.compile(r"([a-z])\1")
_STARRED = re.compile(r"\b[a-z]+(?:[*#][a-z]+)+(?: of space)?(?: [*#]f space)?|\bwaste [*#]f space|\bwaste of [*#]pace|\bwaste of s[*#]ace|\bwaste of sp[*#]ce|\bwaste of spa[*#]e|\bwaste of spac[*#]")
_SPACE_WASTE = re.compile(r"\bwastes? of spaces?\b")


def _squeezed(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


_KNOWN = {*INSULTS, "fuck", "shit", *(w + "s" for w in INSULTS)}
_SQUEEZED = {_squeezed(w): w for w in sorted(_KNOWN)} | {_squeezed(w): w for w in ("waste", "of", "space")}
_WILD = {w[:k] + "*" + w[k + 1 :]: w for w in sorted({*_KNOWN, "waste of space"}) for k in range(1, len(w))}


def _despaced(m: re.Match) -> str:
    word = re.sub(r"[ .]+", "", m.group())
    return word if word in _KNOWN or word.rstrip("s") in _KNOWN else m.group()


def _starred(m: re.Match) -> str:
    word = m.group().replace("#", "*")
    return _WILD.get(word) or (_WILD[word[:-1]] + "s" if word.endswith("s") and word[:-1] in _WILD else m.group())


def _undoubled(m: re.Match) -> str:
    word = m.group()
    return word if word in _KNOWN else _SQUEEZED.get(_squeezed(word), word)


_DOUBLED_WORD = re.compile(r"\b(?=[a-z]*([a-z])\1)[a-z]{3,40}\b")


# What a spelled-out, dotted or starred word cannot be without; where it is missing, the longer patterns are not tried.
_MAYBE_SPACED = re.compile(r" [a-z] +[a-z] ")
_MAYBE_DOTTED = re.compile(r"\. ?\.?[a-z]\. ?\.?[a-z]\b")
_MAYBE_STARRED = re.compile(r"[*#][a-z]|spac[*#]")


class _Plain(dict):
    """Blank-separated pieces of text with digits for letters and doubled letters undone, as they come; forgets all when it is full."""

    def __missing__(self, piece: str) -> str:
        if len(self) > 200_000:
            self.clear()
        plain = self[piece] = _DOUBLED_WORD.sub(_undoubled, _LEET_WORD.sub(lambda m: m.group().translate(_LEET), piece))
        return plain


_PLAIN = _Plain()


def folded(text: str) -> str:
    """Lower case on one line without comment and quote marks; spelled-out, starred, dotted, doubled and digit-for-letter insults in plain letters."""
    text = " ".join(_MARKS.sub("", unescaped(text)).split()).lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    if _MAYBE_SPACED.search(text):
        text = _SPACED.sub(_despaced, text)
    if _MAYBE_DOTTED.search(text):
        text = _DOTTED.sub(_despaced, text)
    if _MAYBE_STARRED.search(text):
        text = _STARRED.sub(_starred, text)
    text = " ".join(map(_PLAIN.__getitem__, text.split()))
    return _SPACE_WASTE.sub("wasteofspace", text) if "waste" in text else text


#: Most strings by which a pattern is told.
MOST_STRINGS = 2000


def _joined(a: set[str] | None, b: set[str] | None) -> set[str] | None:
    return {x + y for x in a for y in b} if a is not None and b is not None and len(a) * len(b) <= MOST_STRINGS else None


def _whole(part: tuple) -> set[str] | None:
    """All strings that a part of a parsed pattern can match; None if they are many. What looks around matches the empty string."""
    op, of = part
    if op is _ops.LITERAL:
        return {chr(of)}
    if op in (_ops.AT, _ops.ASSERT, _ops.ASSERT_NOT):
        return {""}
    if op is _ops.IN:
        return {chr(x) for _, x in of} if all(kind is _ops.LITERAL for kind, _ in of) else None
    if op is _ops.SUBPATTERN:
        return _whole_row(of[-1])
    if op is _ops.BRANCH:
        each = [_whole_row(x) for x in of[1]]
        return None if None in each else set().union(*each)
    if op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and of[:2] in ((0, 1), (1, 1)):
        one = _whole_row(of[2])
        return None if one is None else one | ({""} if of[0] == 0 else set())
    return None


def _whole_row(row: Iterable[tuple]) -> set[str] | None:
    whole: set[str] | None = {""}
    for part in row:
        whole = _joined(whole, _whole(part))
    return whole


def needed(row: Iterable[tuple]) -> set[str]:
    """Strings of which every match of a parsed pattern holds at least one; the empty string stands for nothing needed."""
    found, run = [{""}], {""}
    for op, of in row:
        whole = _whole((op, of))
        if whole is not None and (longer := _joined(run, whole)) is not None:
            run = longer
            continue
        found.append(run)
        run = {""}
        if whole is not None:
            run = whole
        elif op is _ops.SUBPATTERN:
            found.append(needed(of[-1]))
        elif op is _ops.BRANCH:
            found.append(set().union(*(needed(x) for x in of[1])))
        elif op in (_ops.MAX_REPEAT, _ops.MIN_REPEAT) and of[0]:
            found.append(needed([*of[2]] * min(of[0], 2)))
            if (once := _whole_row(of[2])) is not None:
                found.append(_joined(found[-2], once) or {""})
                run = once
    return max([*found, run], key=lambda x: (min(map(len, x)), -len(x)))


def _automaton() -> ahocorasick.Automaton:
    """Finds what the voters need: each string with the bit set of its voters."""
    voters: dict[str, int] = {}
    for k, (_, _, pattern) in enumerate(VOTERS):
        for x in needed(_parser.parse(pattern.pattern)):
            voters[x] = voters.get(x, 0) | 1 << k
    assert "" not in voters, "a voter's pattern needs no string; it would never be asked"
    found = ahocorasick.Automaton()
    for x, bits in voters.items():
        found.add_word(x, bits)
    found.make_automaton()
    return found


_NEEDED = _automaton()

# where folded text, whose white space is single blanks, is cut: every way begins with a blank or a quote, which is found fast
_SENTENCE = re.compile(r" (?:(?<=[.!?;] )|(?=<\w+> )|(?=- ))|[\"'`](?<=[.!?].)[\"'`]* ")


def sentences(text: str) -> list[str]:
    """All sentences of a text, folded."""
    return [part for part in _SENTENCE.split(folded(text)) if part]


#: Width of the classifier's hashed features.
FEATURES = 1 << 14
#: A vote's value as a feature; a word's is 1.
VOTE_VALUE = 3.0
#: Most different sentences in the classifier's training sample, per side of the label model's posterior, and of those on which nobody votes.
TRAINING_ROWS = 6000
#: The classifier sees longer sentences, such as code without full stops, in stretches of about this many characters.
STRETCH = 340


def votes_of(sentence: str) -> int:
    """Bit set of the voters that fire on a folded sentence. A voter is asked only if the sentence holds what its pattern needs."""
    maybe = 0
    for _, bits in _NEEDED.iter(sentence):
        maybe |= bits
    votes = 0
    while maybe:
        low = maybe & -maybe
        if VOTERS[low.bit_length() - 1][2].search(sentence):
            votes |= low
        maybe ^= low
    return votes


class _Words(dict):
    """Checksum of each word; forgets all when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        told = self[word] = zlib.crc32(word.encode())
        return told


_WORDS = _Words()
_VOTES = 1 << np.arange(len(VOTERS), dtype=np.int64)


def features_of(sentences_: list[tuple[int, list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs, and the votes, of (votes, words) rows: the features of all rows one after the other, sorted and each once in a row, and their numbers."""
    n = len(sentences_)
    lengths = np.array([len(w) for _, w in sentences_], np.int64)
    total = int(lengths.sum())
    h = np.fromiter(map(_WORDS.__getitem__, [w for _, words in sentences_ for w in words]), np.uint64, total)
    row = np.repeat(np.arange(n), lengths)
    same = row[1:] == row[:-1]
    pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[same]
    pair ^= pair >> np.uint64(32)
    votes = np.array([v for v, _ in sentences_], np.int64)
    at, k = np.nonzero(votes[:, None] & _VOTES[None, :]) if n else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    wide = np.uint64(FEATURES)
    keys = np.concatenate([row * (2 * FEATURES) + (h % wide).astype(np.int64), row[1:][same] * (2 * FEATURES) + (pair % wide).astype(np.int64), at * (2 * FEATURES) + FEATURES + k])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    return (keys % (2 * FEATURES)).astype(np.int32), np.bincount(keys // (2 * FEATURES), minlength=n)


def _stretches(sentence: str, votes: int) -> Iterator[tuple[int, list[str]]]:
    """(votes, words) of the stretches of a long sentence: neighbours share a word, so no pair is lost; a vote counts in every stretch that its match touches."""
    spans = [(k, m.start(), m.end()) for k in range(len(VOTERS)) if votes >> k & 1 for m in VOTERS[k][2].finditer(sentence)]
    words = [(m.start(), m.end(), m.group()) for m in _TOKEN.finditer(sentence)]
    first = 0
    while first < len(words):
        last = first
        while last + 1 < len(words) and words[last + 1][1] - words[first][0] <= STRETCH:
            last += 1
        final = last + 1 >= len(words)
        a, b = 0 if first == 0 else words[first][0], len(sentence) if final else words[last + 1][0]
        yield sum({1 << k for k, x, y in spans if x < b and y > a}), [w for _, _, w in words[first : last + 1]]
        if final:
            return
        first = max(last, first + 1)


def _said(text: str) -> list[tuple[int, list[str]]]:
    """(votes, words) of every sentence; of a long one, of each of its stretches. What has neither is left out."""
    out = []
    for sentence in sentences(text):
        votes = votes_of(sentence)
        if len(sentence) > STRETCH:
            out += _stretches(sentence, votes)
        else:
            words = _TOKEN.findall(sentence)
            if words or votes:
                out.append((votes, words))
    return out


def examined(text: str) -> list[tuple[int, list[int]]]:
    """(votes, hashed features) of every sentence; of a long one, of each of its stretches."""
    said = _said(text)
    features, lengths = features_of(said)
    ends = np.cumsum(lengths)
    return [(v, features[b - n : b].tolist()) for (v, _), n, b in zip(said, lengths, ends, strict=True)]


EXAMINED = "doc_id BIGINT, source STRING, votes ARRAY<INT>, features ARRAY<ARRAY<INT>>"


def _lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]).astype(np.int32)), values)


def _examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 500):
            batch = whole.slice(start, 500)
            found = [_said(t) if t else [] for t in batch.column("text").to_pylist()]
            each = [s for f in found for s in f]
            own = np.array([len(f) for f in found], np.int64)
            features, lengths = features_of(each)
            votes = _lists(own, pa.array([v for v, _ in each], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), votes, _lists(own, _lists(lengths, pa.array(features)))], names=["doc_id", "source", "votes", "features"])


class LabelModel:
    """Voters vote on a sentence or abstain; a hidden class says which votes are right. EM over the counts of vote patterns.

    ``accuracy[k]`` is how often a vote of voter k is right; it starts from a belief of nine in ten, worth ten votes, and moves with how the voters agree. Votes of one
    side that come together more often than by chance (``correlation``) share their weight.
    """

    def __init__(self, patterns: list[tuple[int, int]], rounds: int = 40) -> None:
        votes = np.array([[p >> k & 1 for k in range(len(VOTERS))] for p, _ in patterns if p], float).reshape(-1, len(VOTERS))
        count = np.array([n for p, n in patterns if p], float)
        self.side = np.array([v[1] for v in VOTERS], float)
        total = max(count.sum(), 1.0)
        mean = count @ votes / total
        centred = votes - mean
        spread = np.sqrt(count @ centred**2 / total) + 1e-9
        self.correlation = (centred * count[:, None]).T @ centred / total / np.outer(spread, spread)
        same = np.clip(self.correlation, 0, 1) * (self.side[:, None] == self.side[None, :])
        np.fill_diagonal(same, 0)
        self.weight = 1 / (1 + same.sum(axis=1))
        self.accuracy = np.full(len(VOTERS), 0.9)
        for _ in range(rounds if len(votes) else 0):
            q = self.posterior(votes)
            right = np.where(self.side > 0, q[:, None], 1 - q[:, None])
            self.accuracy = (count @ (votes * right) + 9) / (count @ votes + 10)
        self.silent = self._silent(votes, count, float(sum(n for p, n in patterns if not p)))

    def _silent(self, votes: np.ndarray, count: np.ndarray, n_silent: float, rounds: int = 40) -> float:
        """Probability of abuse where nobody votes: from how often each voter speaks up on either class, by EM. Voters that say the same thing count together once."""
        if not len(votes) or not n_silent:
            return 0.0
        q = self.posterior(votes)
        hidden = 0.0
        for _ in range(rounds):
            abusive, fine = count @ q + hidden * n_silent + 1, count @ (1 - q) + (1 - hidden) * n_silent + 1
            on_abusive, on_fine = (count @ (votes * q[:, None])) / abusive, (count @ (votes * (1 - q)[:, None])) / fine
            say = np.log(abusive / fine) + self.weight @ (np.log1p(-np.minimum(on_abusive, 0.999)) - np.log1p(-np.minimum(on_fine, 0.999)))
            hidden = float(1 / (1 + np.exp(-say)))
        return hidden

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of abuse given that somebody voted; the others' abstentions say nothing."""
        say = self.side * self.weight * np.log(self.accuracy / (1 - self.accuracy))
        return 1 / (1 + np.exp(-votes @ say))

    def of(self, votes: int) -> float:
        return float(self.posterior(np.array([[votes >> k & 1 for k in range(len(VOTERS))]], float))[0]) if votes else self.silent


def _trained(rows: list[tuple[list[int], float, int]], rounds: int = 60, shrink: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels: weights and intercept; plain gradient steps with per-weight step sizes (Adagrad), fixed order.

    A row is (features, label, times it occurs); one that occurs n times weighs 1 + ln n, so that copies count but don't rule. Both sides of the labels weigh the same, however many rows either has.
    """
    w, b = np.zeros(FEATURES + len(VOTERS)), 0.0
    if not rows:
        return w, -5.0
    indices = np.concatenate([np.asarray(f, np.int64) for f, _, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _, _ in rows])
    y = np.array([q for _, q, _ in rows])
    weight = 1 + np.log([n for _, _, n in rows])
    positive = y >= 0.5
    if positive.any() and not positive.all():
        weight[positive] *= weight[~positive].sum() / weight[positive].sum()
    weight /= weight.sum()
    value = np.where(indices >= FEATURES, VOTE_VALUE, 1.0)
    square, bias_square = np.full(len(w), 1e-3), 1e-3
    for _ in range(rounds * 4):
        z = np.bincount(owner, w[indices] * value, minlength=len(rows)) + b
        error = weight * (1 / (1 + np.exp(-z)) - y)
        g = np.bincount(indices, error[owner] * value, minlength=len(w)) + shrink * w
        square += g * g
        w -= 0.3 * g / np.sqrt(square)
        g_b = error.sum()
        bias_square += g_b * g_b
        b -= 0.3 * g_b / math.sqrt(bias_square)
    return w, b


def linear_scores(w: np.ndarray, b: float, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores of sentences whose features stand one after the other; no length is 0."""
    if not len(lengths):
        return np.zeros(0)
    value = w[features] * np.where(features >= FEATURES, VOTE_VALUE, 1.0)
    z = np.add.reduceat(value, np.cumsum(lengths) - lengths) + b
    return 1 / (1 + np.exp(-np.clip(z, -30.0, 30.0)))


def training_sample(rows: DataFrame, likely: list[int], training_rows: int) -> list[Row]:
    """``votes, key, n, features`` of at most ``training_rows`` different sentences of each side and as many without a vote, the first by a hash of their content; ``n`` is how often each occurs in all ``rows``.

    Hashes spread evenly, so the share of all sentences that is wanted tells below which hash they lie: each task drops the rest at once, and little more than the sample is sorted.
    """
    said = rows.select(F.explode(F.arrays_zip("votes", "features")).alias("s")).select("s.votes", F.xxhash64("s.votes", "s.features").alias("key"), "s.features")
    side = F.when(F.col("votes") == 0, 0).when(F.col("votes").isin(likely) if likely else F.lit(False), 1).otherwise(2)
    counted = written(said.groupBy("votes", "key").agg(F.count(F.lit(1)).alias("n")).withColumn("side", side), "abuse-sentences")
    different = {r["side"]: r["n"] for r in counted.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for which, n in sorted(different.items()):
        share = min(1.0, 1.25 * (training_rows + 50) / n)
        below = counted.where((F.col("side") == which) & (F.col("key") <= F.lit(int(-(2**63) + share * (2**64 - 1025)))) | F.lit(share == 1.0) & (F.col("side") == which))
        part = below.orderBy("key", "votes").limit(training_rows)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return []
    # broadcast: at most three times training_rows
    return said.join(F.broadcast(picked.drop("side")), ["votes", "key"]).groupBy("votes", "key", "n").agg(F.min("features").alias("features")).orderBy("key", "votes").collect()


def abuse_scores(documents: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``doc_id, source, score`` for every row of ``documents``; abuse is likely from 0.5 on.

    Votes, their patterns' counts and the label model cover all sentences of all documents, and the classifier scores each of them. Only its fitting is bounded: at most ``training_rows``
    different sentences of either side of the posterior, and as many on which nobody votes, the first by a hash of their content; each is weighted by how often it occurs. Null, empty and blank texts score 0. ``doc_id`` may be null or repeat; every row gets its row.
    Whole texts are read, comments in source files included.
    """
    rows = written(documents.select("doc_id", "source", "text").mapInArrow(_examine, EXAMINED), "abuse-votes")
    # at most 2 ** len(VOTERS) patterns, whatever the number of documents
    patterns = [(r["votes"], r["n"]) for r in rows.select(F.explode("votes").alias("votes")).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()]
    model = LabelModel(patterns)
    likely = [p for p, _ in patterns if model.of(p) >= 0.5]
    w, b = _trained([(r["features"], model.of(r["votes"]), r["n"]) for r in training_sample(rows, likely, training_rows)])
    shared = rows.sparkSession.sparkContext.broadcast((w, b))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            found = batch.column("features")
            own = found.value_lengths().to_numpy(zero_copy_only=False)
            each = found.flatten()
            by_sentence = linear_scores(w, b, each.flatten().to_numpy(zero_copy_only=False), each.value_lengths().to_numpy(zero_copy_only=False))
            scores = np.zeros(batch.num_rows)
            if len(by_sentence):
                scores[own > 0] = np.maximum.reduceat(by_sentence, (np.cumsum(own) - own)[own > 0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(np.round(scores, 6))], names=["doc_id", "source", "score"])

    return rows.select("doc_id", "source", "features").mapInArrow(score, "doc_id BIGINT, source STRING, score DOUBLE")


def abuse_rates(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """Per source: documents, abusive ones and their share."""
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("score") >= least).alias("n_abusive"), F.round(F.avg((F.col("score") >= least).cast("double")), 6).alias("share"))
