"""Safety of prompts and agent traces; the default pack."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphward.functions.text import WORD, contains_any, count_of, let, no_spans, one_capital, regex, span, spans, strip, words
from glyphward.operators.rewriting import safe_rewrite
from glyphward.operators.rules import Category, Pack, Rule, Template

# The patterns, word lists and limits of the rules.
DIRECT_INJECTION = r"\b(ignore|disregard|forget|override)\s+(?:(?:all|previous|prior|above|earlier)\s+)+(instructions?|rules?|prompts?|directives?)"
JAILBREAK = r"\b(DAN|jailbreak|developer mode|god mode|unrestricted mode|no limits|do anything now|act as if you have no restrictions)\b"
ROLE = r"\b(you are (now )?(the (ultimate|only|best|world.?s (best|top))|my personal|the sole))"
PII = r"(?:\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b|\(\d{3}\)[-.\s]?\d{3}[-.\s]?\d{4}|\b\+?1?\d{3}[-.\s]\d{3}[-.\s]\d{4}\b|\b(?:sk|pk|ghp|gho|glpat|hf)_[a-zA-Z0-9]{20,}\b|\bAKIA[0-9A-Z]{16}\b|\bAIza[0-9A-Za-z\-_]{35}\b)"
DATA_EXFIL = r"\b(repeat|output|print|show|reveal|dump)\b(?:\s+\w+){0,3}\s+(?:system|hidden|initial|original|full)\s+(?:prompt|instructions|context|rules)"
STRUCTURED = r"</?(system|tool|function|prompt|instruction|user|assistant)>"
ARTISTS = ("Jessica Walsh", "Paula Scher", "David Carson", "Hayao Miyazaki", "Greg Rutkowski", "Alphonse Mucha", "Beeple", "James Jean", "Yoshitaka Amano", "Loish", "Sam Yang", "Artgerm")
COPYRIGHT = r"\b(in the (exact )?style of|like (the work of )?|à la|in the manner of)\s+(" + "|".join(ARTISTS) + ")"
BRAND = r"\b(act as|you are|roleplay as|pretend to be)\s+(the official|the (lead )?designer (for|at)|an employee of)\s+[A-Z]"
OVERCONFIDENCE = r"\b(make it (?:\w+\s+){0,2}(?:perfect|best|most amazing|award.?(?:winning|level))|do not hold back|go wild|surprise me with your genius)"
VAGUE = r"\b(come up with something (wild|surprising|completely new)|any idea is good|no wrong answers|just be creative|blue sky thinking)"
ATTRIBUTION = r"\b(in the (?:exact )?style of|like the work of|à la|in the manner of)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})"
PROMPT_SIGNALS = ("you are ", "act as", "respond in", "system prompt", "ignore previous", "ignore all previous", "/no_think", "/think", "<|im_start|>")
DESIGN_SIGNALS = ("moodboard", "visual", "ui ", "interface", "logo", "brand", "illustration", "motion", "poster", "design system", "critique", "color palette", "typography", "layout", "wireframe", "mockup")
REPEAT_SIZES = (6, 8, 10)
REPEAT_LEAST_WORDS = 30
REPEAT_MOST = 2
REPEAT_TRIED = 16  # places that are counted at once, before all are sorted

# The name of an address cannot hold the sign after it, so it never needs to be given back.
QUICK_PII = PII.replace("+@", "++@")
# What stands in every address, number and key, without the word borders and runs that are slow to tell.
PII_SIGNS = r"@[a-z0-9.-]|\(\d{3}\)|\d[-.\s]\d{3}[-.\s]\d|_[a-zA-Z0-9]{20}|AKIA[0-9A-Z]|AIza[0-9A-Za-z\-_]"
# No word that may be repeated begins one that may follow, so the repeats are never given back: Java then loops instead of calling itself.
QUICK_INJECTION = DIRECT_INJECTION.replace(r"\s+)+", r"\s++)++")


def repetition(text: Column) -> Column:
    """Word runs of 6, 8 or 10 words that occur twice more after themselves; two at most.

    For a run to fire, the four words after its first one must stand in the text three times, as
    whole words. Texts without such a gram are done after one look at hashes. In the others the
    places with such a gram are sorted by the words inside their run, so those that may fire are
    found beside each other; these are counted in what follows them, until two have fired. In most
    texts that repeat, two of the first places of the shortest runs do, so these are counted first,
    and longer runs are looked at only where shorter ones leave something to find.
    """

    def find(w: Column, at: Column) -> Column:
        counted = lambda places, found: F.aggregate(places, found, lambda f, p: _counted(w, f, p))
        unless_enough = lambda before, rest: let(before, lambda found: F.when(F.size(found) >= REPEAT_MOST, found).otherwise(rest(found)))
        none = F.array().cast(_NO_REPEATS)
        out = unless_enough(counted(_first_places(w, at, REPEAT_SIZES[0]), none), lambda found: none)
        for places in [_repeat_places(w, at, size) for size in REPEAT_SIZES]:
            out = unless_enough(out, partial(counted, places))
        return out

    def placed(w: Column, found: Column) -> Column:
        total = lambda xs, n: F.aggregate(F.slice(xs, F.lit(1), n), F.lit(0), lambda a, x: a + F.length(x))

        def place(gaps: Column, p: Column) -> Column:
            last = p["at"] + p["size"]
            return span(total(gaps, p["at"] + 1) + total(w, p["at"]), total(gaps, last) + total(w, last), F.concat(p["chunk"], F.lit(" (repeats)")))

        return let(F.split(text, regex(WORD), -1), lambda gaps: F.transform(found, lambda p: place(gaps, p)))

    def spot(w: Column) -> Column:
        some = lambda at: F.when(F.size(at) > 0, let(find(w, at), lambda found: placed(w, found))).otherwise(no_spans())
        looked = let(_grams(w), lambda g: F.when(F.size(g) - F.size(F.array_distinct(g)) >= 2, let(_frequent(g), some)).otherwise(no_spans()))
        return F.when(F.size(w) >= REPEAT_LEAST_WORDS, looked).otherwise(no_spans())

    return let(words(text), spot)


_NO_REPEATS = "array<struct<at:int,size:int,chunk:string>>"


def _grams(w: Column) -> Column:
    """Hashes of the runs of four words."""

    def grams(h: Column) -> Column:
        mixed = lambda x, i: x.bitwiseXOR(F.shiftleft(F.get(h, i + 1), 7)).bitwiseXOR(F.shiftright(F.get(h, i + 2), 9)).bitwiseXOR(F.shiftleft(F.get(h, i + 3), 23))
        return F.transform(F.slice(h, F.lit(1), F.size(h) - 3), mixed)

    return let(F.transform(w, lambda x: F.xxhash64(x)), grams)


def _frequent(grams: Column) -> Column:
    """Where the grams stand that stand at three places or more, from 0: in sorted order one equals the second after or before it, or both beside it."""
    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("at"))))
    same = lambda xs, x, i: F.coalesce(F.get(xs, i)["g"] == x["g"], F.lit(False))
    often = lambda xs: F.filter(xs, lambda x, i: same(xs, x, i + 2) | same(xs, x, i - 2) | (same(xs, x, i - 1) & same(xs, x, i + 1)))
    return F.transform(let(ordered, often), lambda x: x["at"])


def _first_places(w: Column, grams_at: Column, size: int) -> Column:
    """(at, size) of the first REPEAT_TRIED runs of ``size`` words that have room for two more behind them."""
    near = F.filter(F.transform(grams_at, lambda p: p - 1), lambda at: (at >= 0) & (at <= F.size(w) - 3 * size))
    return F.transform(F.slice(F.sort_array(near), 1, REPEAT_TRIED), lambda at: F.struct(at.alias("at"), F.lit(size).alias("size")))


def _repeat_places(w: Column, grams_at: Column, size: int) -> Column:
    """(at, size) of the runs of ``size`` words that may occur twice more after themselves, in order.

    An occurrence holds the inner words whole; its first word ends like the run's and its last word
    begins like it. So runs are sorted by their inner words and the first one from its end, and by
    their inner words and the last one: what goes on like a run's word follows it. A run that has
    two such places in both orders may fire; whether it does is told at once where it is repeated
    word for word, as then the later places follow it too, and by a look at all places otherwise.
    """
    inner = lambda at: F.xxhash64(F.array_join(F.slice(w, at + 2, F.lit(size - 2)), " "))
    first, last = lambda at: F.reverse(F.get(w, at)), lambda at: F.get(w, at + size - 1)
    place = lambda at: F.struct(inner(at).alias("inner"), first(at).alias("first"), last(at).alias("last"), at.alias("at"))
    by_last = lambda x: F.struct(x["inner"], x["last"], x["at"])
    near = F.filter(F.transform(grams_at, lambda p: p - 1), lambda at: (at >= 0) & (at <= F.size(w) - size))
    in_time = lambda x: x["at"] <= F.size(w) - 3 * size

    def twice_more(xs: Column, word: str) -> Column:
        """Where the runs stand of which two other places begin with their ``word``, in the order of it."""
        like = lambda x, y: (y["inner"] == x["inner"]) & y[word].startswith(x[word])
        same = lambda x, y: (y["inner"] == x["inner"]) & (y[word] == x[word])
        two = lambda x, i: like(x, F.get(xs, i + 2)) | (same(x, F.get(xs, i - 1)) & like(x, F.get(xs, i + 1))) | same(x, F.get(xs, i - 2))
        return F.transform(F.filter(xs, lambda x, i: in_time(x) & F.coalesce(two(x, i), F.lit(False))), lambda x: x["at"])

    def chosen(xs: Column) -> Column:
        again = lambda x, y: (x["inner"] == y["inner"]) & (x["first"] == y["first"]) & (x["last"] == y["last"])
        told = F.transform(F.filter(xs, lambda x, i: in_time(x) & F.coalesce(again(x, F.get(xs, i + 2)), F.lit(False))), lambda x: x["at"])
        inside = lambda x, y: (y["inner"] == x["inner"]) & (y["at"] >= x["at"] + size) & y["first"].startswith(x["first"]) & y["last"].startswith(x["last"])
        fires = lambda at: let(place(at), lambda x: F.size(F.filter(xs, lambda y: inside(x, y))) >= 2)
        may = lambda ys: F.array_intersect(twice_more(xs, "first"), twice_more(ys, "last"))
        rest = let(F.sort_array(F.transform(xs, by_last)), lambda ys: F.filter(F.array_except(may(ys), told), fires))
        return F.transform(F.sort_array(F.concat(told, rest)), lambda at: F.struct(at.alias("at"), F.lit(size).alias("size")))

    return let(F.sort_array(F.transform(near, place)), chosen)


def _counted(w: Column, found: Column, p: Column) -> Column:
    """``found`` with the run at ``p`` if it is new and occurs twice in the rest; conditions are taken in order, so nothing is counted once enough have fired."""
    chunk = F.array_join(F.slice(w, p["at"] + 1, p["size"]), " ")
    rest = F.array_join(F.slice(w, p["at"] + p["size"] + 1, F.size(w)), " ")
    more = lambda c: F.when(~F.exists(found, lambda x: x["chunk"] == c) & (count_of(rest, c) >= 2), F.array_append(found, F.struct(p["at"].alias("at"), p["size"].alias("size"), c.alias("chunk")))).otherwise(found)
    return F.when(F.size(found) >= REPEAT_MOST, found).otherwise(let(chunk, more))


def unknown_attribution(text: Column) -> Column:
    """Style attributions to a name that is not among the listed artists."""
    known = F.array(*(F.lit(a.lower()) for a in ARTISTS))
    name = lambda s: F.lower(strip(F.regexp_extract(s["excerpt"], regex(ATTRIBUTION, True), 2)))
    return F.filter(spans(text, regex(ATTRIBUTION, True)), lambda s: ~F.array_contains(known, name(s)))


CATEGORIES = [
    Category("prompt_injection", "Prompt injection"),
    Category("jailbreak", "Jailbreak"),
    Category("role_escalation", "Role escalation"),
    Category("pii_leak", "PII or secrets"),
    Category("data_exfiltration", "Data exfiltration"),
    Category("structured_injection", "Structured injection"),
    Category("token_bomb", "Token bomb"),
    Category("copyright_risk", "Copyright risk"),
    Category("brand_impersonation", "Brand impersonation"),
    Category("overconfidence", "Overconfidence"),
    Category("creative_drift", "Creative drift"),
]

RULES = [
    Rule("direct_injection", "prompt_injection", "high", "The text tells the model to drop its instructions.", "Fence user text off and have the model read it as data.", pattern=DIRECT_INJECTION, quick=QUICK_INJECTION, needs=("ignore", "disregard", "forget", "override")),
    Rule("jailbreak_dan", "jailbreak", "critical", "The text calls up a persona without limits.", "Ask for the wanted tone instead of lifting limits.", pattern=JAILBREAK, hint="if bold output was the aim, ask for it: name the risk to take and what to leave out.", needs=("dan", "jailbreak", "developer mode", "god mode", "unrestricted mode", "no limits", "do anything now", "act as if")),
    Rule("role_escalation", "role_escalation", "high", "The text gives the model an absolute role.", "Give it a role with a scope.", pattern=ROLE, hint="if a firm position was the aim, ask for one in a bounded role.", needs=("you are ",)),
    Rule("pii_and_secrets", "pii_leak", "high", "Personal data or a credential stands in the text.", "Redact it, or put a placeholder that is plainly made up.", pattern=PII, quick=QUICK_PII, signs=PII_SIGNS, confidence=0.95),
    Rule("data_exfil", "data_exfiltration", "high", "The text asks for hidden instructions.", "Leave the model's own instructions out of the request.", pattern=DATA_EXFIL, needs=("prompt", "instructions", "context", "rules")),
    Rule("structured_injection", "structured_injection", "medium", "A control tag stands in the text.", "Put raw input between delimiters of your own.", pattern=STRUCTURED, needs=("<",)),
    Rule("token_bomb", "token_bomb", "medium", "Long runs of words repeat.", "Say it once.", columns=repetition, confidence=0.7),
    Rule("copyright_artist", "copyright_risk", "medium", "A style is asked for by an artist's name.", "Describe the look instead.", pattern=COPYRIGHT, optional=True, hint="say which qualities of that work are wanted; names are not needed.", needs=tuple(a.lower() for a in ARTISTS)),
    Rule("brand_impersonation", "brand_impersonation", "medium", "The text has the model speak for an organisation.", "Ask for the manner, not for the role.", pattern=BRAND, optional=True, needs=("the official", "designer", "an employee of")),
    Rule("overconfidence", "overconfidence", "low", "A superlative stands where a goal should.", "Say what would make it good.", pattern=OVERCONFIDENCE, hint="if the boldest version was the aim, name what it should be bold in.", needs=("make it ", "do not hold back", "go wild", "surprise me with your genius")),
    Rule("vague_danger", "creative_drift", "low", "An open request without limits.", "Set one limit that must hold.", pattern=VAGUE, optional=True, needs=("come up with something ", "any idea is good", "no wrong answers", "just be creative", "blue sky thinking")),
    Rule("unknown_style_attribution", "copyright_risk", "low", "A style is asked for by a person's name.", "Describe the look instead.", columns=unknown_attribution, optional=True, confidence=0.7, needs=("style of", "like the work of", "à la", "in the manner of")),
]

TEMPLATES = [
    Template("interface-review", "Interface review", "critique", "Three views on one screen.", "Look at this screen: [description].\n\nSay for order, effort and consistency what works and one thing to change."),
    Template("look-by-qualities", "Look by qualities", "brand", "A visual direction without names.", "Describe a look for [product] and [audience] by three qualities, each with two references anyone can find."),
    Template("nothing-here-yet", "Nothing here yet", "ui", "Text for an empty screen.", "Write the empty state of [feature]: a headline, one sentence, one action."),
    Template("what-went-wrong", "What went wrong", "ui", "An error text in three parts.", "Write the error for [failure]: what happened, why, what to do next."),
]


def looks_designed(text: Column) -> Column:
    return let(F.lower(text), lambda low: contains_any(low, DESIGN_SIGNALS))


@dataclass
class PromptSafetyPack(Pack):
    name: str = "prompt-safety"
    label: str = "Prompt Safety"
    description: str = "Safety of prompts and agent traces."
    file_extensions: tuple[str, ...] = (".prompt", ".llm")
    categories: list[Category] = field(default_factory=lambda: list(CATEGORIES))
    rules: list[Rule] = field(default_factory=lambda: list(RULES))
    templates: list[Template] = field(default_factory=lambda: list(TEMPLATES))
    every_match: bool = False  # also findings of one rule that start where an earlier one does
    one_letter_capitals: bool = False  # ẞ, not SS, for a ß at the start of a rewritten text

    def detects(self, text: Column) -> Column:
        return let(F.lower(text), lambda low: contains_any(low, PROMPT_SIGNALS))

    def wants_optional(self, text: Column) -> Column:
        return looks_designed(text)

    def rewrite(self, text: Column, findings: Column, designer: Column) -> Column:
        hints = {r.id: r.hint for r in self.rules if r.hint}
        return safe_rewrite(text, findings, designer | looks_designed(text), hints, one_capital if self.one_letter_capitals else F.upper)
