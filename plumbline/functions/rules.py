"""Action-object rules matched by one automaton over all their stems.

The stems and phrases of all rules stand in one Aho-Corasick automaton with
bit masks of the rules they belong to. A distinct word meets it once per
worker, a distinct sentence too, and a response once: its masks answer every
rule together.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa

from plumbline.functions.text import LEAD, LINE_BREAKS, SENTENCE_END, TOKEN
from plumbline.functions.worker import kept

# Shorter words name a target only weakly where they are a mere beginning of its stem.
WEAK_LENGTH = 3
# Stems of this length count anywhere in a word, shorter ones at its start.
INSIDE_LENGTH = 4
# Words and sentences a worker remembers, and the longest sentence it does.
CACHED = 50_000
CACHED_SENTENCE = 300

# Python's patterns know Unicode without being told.
_BREAKS = re.compile(LINE_BREAKS)
_LEAD = re.compile(LEAD.removeprefix("(?U)"))
_END = re.compile(SENTENCE_END.removeprefix("(?U)"))
_TOKEN = re.compile(TOKEN)


def split_sentences(text: str) -> Iterable[str]:
    """Sentences and list items, as `functions.text.sentences` gives them."""
    for line in _BREAKS.split(text):
        for part in _END.split(_LEAD.sub("", line.strip()).strip()):
            part = part.strip()
            if part:
                yield part


def _automaton(words: Iterable[str]):
    out = ahocorasick.Automaton()
    for word in words:
        out.add_word(word, word)
    out.make_automaton()
    return out


class RuleAutomaton:
    """All rules of one evidence: which of them a text follows."""

    def __init__(self, rules: list[dict], negators: Iterable[str], window: int):
        self.count, self.window, self.negators = len(rules), window, frozenset(negators)
        # Stem -> masks of the rules it is a target of, and an action of.
        self.targets, self.actions = {}, {}
        self.worded = []
        for i, rule in enumerate(rules):
            actions, targets = rule["actions"] or [], rule["targets"] or []
            if not actions or not targets:
                self.worded.append((1 << i, [k.lower() for k in rule["keywords"] or []]))
                continue
            for stems, masks in ((targets, self.targets), (actions, self.actions)):
                for stem in {stem.lower().strip() for stem in stems} - {""}:
                    masks[stem] = masks.get(stem, 0) | 1 << i
        stems = self.targets.keys() | self.actions.keys()
        self.phrases = {stem for stem in stems if " " in stem or "-" in stem}
        self.stems = _automaton(stems - self.phrases)
        # No word holds a space or hyphen, but a phrase may still act as a stem:
        # a word that begins it does not name it, since phrases are met as they stand.
        self.phrase_finder = _automaton(self.phrases)
        closed = "|".join(map(re.escape, negators))
        self.negated = {p: re.compile(rf"\b({closed})\b.{{1,25}}{re.escape(p)}") for p in self.phrases & self.actions.keys()}
        # Words no rule is affirmed by, and sentences already met.
        self.words: dict[str, tuple[int, int, int, bool]] = {}
        self.met: dict[str, tuple[int, int]] = {}

    def _word(self, word: str) -> tuple[int, int, int, bool]:
        """Masks of a word: target, target by a short beginning only, action; and whether it negates."""
        strong = weak = action = 0
        if len(self.stems):
            for end, stem in self.stems.iter(word):
                if end + 1 == len(stem) or len(stem) >= INSIDE_LENGTH:
                    strong |= self.targets.get(stem, 0)
                    action |= self.actions.get(stem, 0)
            for stem in self.stems.values(word):
                if len(word) < WEAK_LENGTH and stem != word:
                    weak |= self.targets.get(stem, 0)
                else:
                    strong |= self.targets.get(stem, 0)
        return strong, weak & ~strong, action, word in self.negators

    def _sentence(self, sentence: str) -> tuple[int, int]:
        lowered = sentence.lower()
        words = _TOKEN.findall(lowered)
        if not words:
            return 0, 0
        strong = weak = acted = 0
        last_negator = -self.window - 1
        for at, word in enumerate(words):
            known = self.words.get(word)
            if known is None:
                if len(self.words) >= CACHED:
                    self.words.clear()
                known = self.words[word] = self._word(word)
            s, w, action, negates = known
            strong |= s
            weak |= w
            if action and at - last_negator > self.window:
                acted |= action
            if negates:
                last_negator = at
        if self.phrases:
            for _, phrase in self.phrase_finder.iter(lowered):
                strong |= self.targets.get(phrase, 0)
                if phrase in self.actions and not self.negated[phrase].search(lowered):
                    acted |= self.actions[phrase]
        return strong & acted, weak & acted

    def sentence(self, sentence: str) -> tuple[int, int]:
        """Masks of the rules a sentence follows, and of those it follows by short words; short sentences are remembered."""
        known = self.met.get(sentence)
        if known is None:
            known = self._sentence(sentence)
            if len(sentence) <= CACHED_SENTENCE:
                if len(self.met) >= CACHED:
                    self.met.clear()
                self.met[sentence] = known
        return known

    def __call__(self, texts: Iterable[str]) -> tuple[int, int]:
        """Masks of the rules some sentence of the texts follows, and of those it follows by short words only."""
        strong = weak = 0
        every = (1 << self.count) - 1
        said = [] if self.worded else None
        for text in texts:
            for sentence in split_sentences(text):
                if said is not None:
                    said.append(sentence)
                if strong == every:
                    continue
                known = self.sentence(sentence)
                strong |= known[0]
                weak |= known[1]
        if self.worded:
            together = " ".join(said).lower()
            for mask, keywords in self.worded:
                if any(keyword in together for keyword in keywords):
                    strong |= mask
        return strong, weak & ~strong


def automaton_of(rules: str, negators: tuple[str, ...], window: int) -> RuleAutomaton:
    """The worker's automaton of a JSON list of rules."""
    return kept(("rules", rules, negators, window), lambda: RuleAutomaton(json.loads(rules), negators, window))


HITS = "array<struct<matched:boolean,weak:boolean>>"
_HITS = pa.list_(pa.struct([("matched", pa.bool_()), ("weak", pa.bool_())]))


def matcher(negators: tuple[str, ...], window: int, rules: str | None = None):
    """An Arrow function of (recommendations, narrative): per response and rule, matched and weak.

    Without `rules` a third column holds those of each response.
    """

    def found(automaton: RuleAutomaton, advice: pa.Scalar, text: pa.Scalar) -> list[dict]:
        strong, weak = automaton([*(part for part in advice.as_py() or [] if part is not None), text.as_py() or ""])
        return [{"matched": bool((strong | weak) >> i & 1), "weak": bool(weak >> i & 1)} for i in range(automaton.count)]

    def shared(recommendations: pa.Array, narrative: pa.Array) -> pa.Array:
        automaton = automaton_of(rules, negators, window)
        return pa.array([found(automaton, advice, text) for advice, text in zip(recommendations, narrative)], _HITS)

    def own(recommendations: pa.Array, narrative: pa.Array, packed: pa.Array) -> pa.Array:
        # Each distinct list of rules becomes a Python text once per batch.
        coded = packed.dictionary_encode()
        automata = [automaton_of(text, negators, window) for text in coded.dictionary.to_pylist()]
        return pa.array(
            [None if code is None else found(automata[code], *row) for code, *row in zip(coded.indices.to_pylist(), recommendations, narrative)],
            _HITS,
        )

    return own if rules is None else shared


def sentence_matcher(negators: tuple[str, ...], window: int, rules: str):
    """An Arrow function of sentences: per sentence and rule, whether it follows the rule's grammar."""

    def hits(sentences: pa.Array) -> pa.Array:
        automaton = automaton_of(rules, negators, window)
        out = []
        for sentence in sentences:
            strong, weak = automaton.sentence(sentence.as_py() or "")
            out.append([bool((strong | weak) >> i & 1) for i in range(automaton.count)])
        return pa.array(out, pa.list_(pa.bool_()))

    return hits
