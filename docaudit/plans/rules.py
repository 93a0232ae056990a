"""Rules as data: what each looks for and when it fires.

Patterns are written for both Java and RE2, so that the SQL of a rule states the same. Word lists are our own and
short; a caller passes longer ones in the same shape. Levels are strict, normal and relaxed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

LEVELS = ("strict", "normal", "relaxed")


def java(pattern: str, ascii_text: bool = False) -> str:
    """The pattern for Spark: RE2's names of scripts, and its word boundary, which knows ASCII alone."""
    scripts = re.sub(r"\\p\{(Han|Hiragana|Katakana|Cyrillic|Greek)\}", r"\\p{Is\1}", pattern)
    # A leading run of a class begins where the run does; Java would try each of its characters as a start.
    scripts = re.sub(r"^(\[\^[^\]]+\])\+", r"(?<!\1)\1+", scripts)
    scripts = re.sub(r"^\(\?:(\[\^[^\]]+\])\*", r"(?<!\1)(?:\1*", scripts)
    return scripts if ascii_text else scripts.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


@dataclass(frozen=True)
class Pattern:
    """A pattern counted in each document; fires at `limits` matches or more, or by density above it."""

    rule: str
    pattern: str
    limits: tuple[float, float, float] = (1, 1, 1)
    lang: str | None = None
    #: each: one finding for each match once the limit is met; density: matches in 1000 words above the limit.
    kind: str = "each"
    severity: str = "warning"


@dataclass(frozen=True)
class Phrases:
    """Phrases matched as whole words, one hit for each sentence at most."""

    rule: str
    phrases: tuple[str, ...]
    limits: tuple[float, float, float] = (1, 1, 2)
    lang: str = "en"
    #: any, start (of a sentence), opening (first four sentences), closing (last paragraph).
    where: str = "any"
    #: least: fires at the limit; above: over it; density: sentences hit in 1000 words over it.
    kind: str = "least"
    severity: str = "warning"


@dataclass(frozen=True)
class Forms:
    """Two ways to write one thing; the rarer one is reported while its bound holds."""

    rule: str
    first: str
    second: str
    limits: tuple[float, float, float] = (49, 34, 20)
    #: least: minority count at the limit or over; count: at most the limit; share: at most so many percent.
    bound: str = "share"
    lang: str | None = None
    severity: str = "info"


#: Signs in running text.
PATTERNS = (
    Pattern("doubled-punctuation", r"[^.,;。、，．；\p{N}\p{L}/](?:,,|;;|,\.|;,|,;|\.,|\.;)|[\p{L}](?:,,|;;|,;|;,)", severity="warning"),
    Pattern("space-before-punctuation", r"\p{L} [.,;?!](?:\s|$)", lang="en"),
    Pattern("missing-space-after-comma", r"\p{Ll},\p{L}", lang="en"),
    Pattern("invisible-character", "[​‌‍⁠﻿­]"),
    Pattern("hankaku-kana", "[｡-ﾟ]+"),
    Pattern("lookalike-character", r"[A-Za-z][\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][A-Za-z]"),
    Pattern("all-caps-shouting", r"(?:\p{Lu}{2,}[!,.]* ){3,}\p{Lu}{2,}", (1, 1, 2)),
    Pattern("numeral-sentence-start", r"(?:^|\n|[.!?] )[0-9][0-9,]* \p{Ll}", lang="en", severity="info"),
    Pattern("calendar-name-case", r"\b(?:on|next|last|every) (?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b|\bin (?:january|february|april|june|july|august|september|october|november|december)\b", lang="en"),
    Pattern("hyphen-as-dash", r"\p{L} - \p{L}|\p{L} ?-- ?\p{L}", (1, 1, 3), lang="en", severity="info"),
    Pattern("latin-abbreviation-form", r"\b(?:e\.g|i\.e)[^.\p{L}]|\b(?:eg|ie)\. ", (1, 1, 2), lang="en"),
    Pattern("ordinal-suffix-mismatch", r"\b[0-9]*(?:1[123](?:st|nd|rd)|(?:^|[^1])1(?:nd|rd|th)|[023456789]1(?:nd|rd|th)|(?:[02-9]|\b)2(?:st|rd|th)|(?:[02-9]|\b)3(?:st|nd|th)|[04-9](?:st|nd|rd))\b"),
    Pattern("article-sound", r"\b[Aa] (?:[aei][b-df-hj-np-tv-z]|o[b-df-hj-mp-tv-z]|hour|honest|heir)\p{Ll}*|\b[Aa]n (?:[bcdfgjklmnpqrstvwyz]\p{Ll}|user|unit|one\b|uni)\p{Ll}*", (1, 1, 2), lang="en"),
    Pattern("unfilled-placeholder", r"\[(?:Your|Insert|Name|Date|Company|TODO)[^\]\n]*\]|\bTODO:|\bTBD\b|\{\{[^}\n]*\}\}|(?i:lorem ipsum)"),
    Pattern("chat-citation-residue", r"utm_source=chatgpt\.com|:contentReference\[|oaicite|【[0-9]+†"),
    Pattern("impossible-time", r"\b(?:1[3-9]|2[0-9]):[0-5][0-9] ?[ap]\.?m\b|\b(?:2[5-9]|[3-9][0-9]):[0-5][0-9]\b|\b[01]?[0-9]:[6-9][0-9]\b|\b(?:1[3-9]|2[0-4]) ?[AP]M\b", severity="error"),
    Pattern("share-over-hundred", r"\b(?:1[0-9][1-9]|1[1-9]0|[2-9][0-9]{2})(?:\.[0-9]+)?% of (?:the |all )?(?:respondents|users|people|customers|students|members|households|votes)", severity="error"),
    Pattern("url-run-on", r"https?://[^\s]+[\p{Han}\p{Hiragana}\p{Katakana}]"),
    Pattern("vague-figure-reference", r"\bthe (?:table|figure|chart|diagram) (?:below|above)\b", lang="en", severity="info"),
    Pattern("expletive-construction", r"(?:^|\n|[.!?] )(?:There (?:is|are|was|were) |It (?:is|was) [^.!?\n]{1,60} that )", (2, 4, 7), lang="en", severity="info"),
    Pattern("sentence-initial-so", r"(?:^|\n|[.!?] )So, ", (1, 1, 3), lang="en", severity="info"),
    Pattern("contrast-framing", r"\b(?:It'?s|This is|That'?s) not (?:just |only )?[^.!?\n]{1,60}[,;.] (?:It|it|This|That)(?:'s| is)\b", (1, 2, 3), lang="en", severity="info"),
    Pattern("unprompted-denial", r"(?:^|\n|[.!?] )(?:This|It|That) (?:isn't|is not|wasn't) about ", (1, 2, 3), lang="en", severity="info"),
    Pattern("q-fragment-answer", r"\?\s+(?:No|Yes|Nope|Absolutely|Exactly|Not quite|Hardly|Never)[.!]", (2, 2, 3), lang="en", severity="info"),
    Pattern("double-negative-form", r"\bnot un\p{Ll}{4,}\b|\bnot in(?:significant|considerable|frequent|appropriate)\b", lang="en", severity="info"),
    Pattern("adverb-overuse", r"\b\p{Ll}{3,}ly\b", (10, 15, 25), lang="en", kind="density", severity="info"),
    Pattern("no-em-dash", r"\p{L} ?— ?\p{L}", (3, 8, 20), kind="density", severity="info"),
    Pattern("emoji-density", "[\U0001f300-\U0001faff☀-➿]", (3, 8, 20), kind="density", severity="info"),
    Pattern("bold-density", r"\*\*[^*\n]+\*\*", (10, 20, 40), kind="density", severity="info"),
    Pattern("digit-density", r"[0-9]+", (20, 40, 80), kind="density", severity="info"),
    Pattern("unrendered-emphasis", r"\*\*\s[^*\n]*\*\*|\*\*\*\*"),
    Pattern("no-nakaguro-parallel", r"[^・\n。]+(?:・[^・\n。]+){5,}", severity="info"),
    Pattern("max-kanji-continuous", r"\p{Han}{9,}", severity="info"),
    Pattern("max-ten", r"(?:[^。、\n]*、){7,}", severity="info"),
    Pattern("connective-hierarchy", r"(?:^|[。\n])(?:[^。及\n]*並びに[^。及\n]*|[^。又\n]*若しくは[^。又\n]*)。"),
    Pattern("repeated-exclamation", r"!!+", (1, 3, 6), severity="info"),
)

#: Word lists.
PHRASES = (
    Phrases("cliche", ("at the end of the day", "low-hanging fruit", "think outside the box", "move the needle", "game changer", "tip of the iceberg")),
    Phrases("wordy-phrase", ("in order to", "due to the fact that", "at this point in time", "in the event that", "for the purpose of", "with regard to", "a large number of", "is able to"), (1, 2, 4)),
    Phrases("redundant-expression", ("end result", "each and every", "past history", "free gift", "basic fundamentals", "advance planning", "completely finished", "close proximity")),
    Phrases("nonstandard-word", ("irregardless", "alot", "anyways", "supposably", "orientate"), (1, 1, 1)),
    Phrases("known-misspelling", ("definately", "seperate", "occured", "recieve", "untill", "accomodate", "acheive", "wich", "teh", "thier"), (1, 1, 1), severity="error"),
    Phrases("homophone-slip", ("it's own", "their are", "could of", "should of", "would of", "loose weight", "your welcome")),
    Phrases("empty-intensifier", ("extremely important", "absolutely essential", "incredibly powerful", "truly unique", "highly effective"), (1, 1, 3)),
    Phrases("uncomparable-graded", ("very unique", "more perfect", "most unique", "completely dead", "very essential")),
    Phrases("double-negative", ("not uncommon", "not unlike", "not impossible", "not unusual", "not insignificant")),
    Phrases("weasel-word", ("many experts say", "studies show", "it is widely believed", "some people say", "research suggests", "critics say")),
    Phrases("ai-tell", ("delve into", "plays a crucial role", "in today's fast-paced world", "a testament to", "rich tapestry", "navigate the complexities"), (1, 2, 3), severity="info"),
    Phrases("assistant-residue", ("i hope this helps", "as an ai language model", "let me know if you", "certainly here is", "feel free to ask"), (1, 1, 2), severity="error"),
    Phrases("honesty-marker", ("honestly", "to be honest", "frankly", "if i'm being honest", "truth be told"), severity="info"),
    Phrases("email-stock-courtesy", ("i hope this email finds you well", "please do not hesitate to", "thank you for your time and consideration", "i look forward to hearing from you"), (2, 2, 3), severity="info"),
    Phrases("requirement-smell", ("as far as possible", "if necessary", "as appropriate", "and/or", "where applicable"), (1, 1, 1), severity="info"),
    Phrases("vague-deadline", ("promptly", "as soon as possible", "in due course", "without delay", "in a timely manner"), (1, 1, 1), severity="info"),
    Phrases("doubled-nado", ("and etc", "etc etc", "and so on and so forth"), (1, 1, 2)),
    Phrases("nado-closed-list", ("only etc", "limited to etc"), (1, 1, 1)),
    Phrases("nominalization", ("make a decision", "conduct an analysis", "give consideration to", "make an assumption", "provide assistance", "perform an evaluation"), (1, 2, 4), kind="density", severity="info"),
    Phrases("excessive-hedging", ("may perhaps", "might possibly", "it is possible that", "could potentially", "seems to", "appears to", "somewhat"), (3, 6, 12), kind="density", severity="info"),
    Phrases("vague-word-density", ("as appropriate", "as needed", "various", "several", "things", "stuff", "and others"), (2, 4, 8), kind="density", severity="info"),
    Phrases("cushion-phrase-density", ("sorry to bother", "just wanted to", "if it's not too much trouble", "i was wondering if", "no worries if not"), (2, 5, 10), kind="density", severity="info"),
    Phrases("figurative-density", ("like magic", "secret sauce", "a double-edged sword", "hidden gem", "unlock the power"), (1, 2, 3), kind="density", severity="info"),
    Phrases("over-general-claim", ("most people", "nobody", "everyone knows", "no one", "everybody"), (2, 3, 5), kind="density", severity="info"),
    Phrases("very-adjective", ("very important", "very good", "very large", "very difficult", "very useful", "very small"), (1, 3, 4), kind="density", severity="info"),
    Phrases("less-for-fewer", ("less errors", "less people", "less items", "less files", "less users", "less steps"), (1, 1, 1)),
    Phrases("agreement-slip", ("these version", "this versions", "those item", "that items", "these document", "a items"), (1, 1, 1)),
    Phrases("stock-transition", ("moreover", "furthermore", "additionally", "in addition", "in conclusion", "overall"), (4, 6, 10), where="start", kind="density", severity="info"),
    Phrases("announcing-opener", ("the key point is", "the bottom line is", "here's the thing", "the important thing is", "it's worth noting that"), (2, 3, 5), where="start", severity="info"),
    Phrases("demonstrative-opener", ("this", "that", "it", "these", "those"), (3, 5, 8), where="start", kind="above", severity="info"),
    Phrases("sentence-initial-conjunction", ("and", "but", "so", "or"), (2, 4, 8), where="start", kind="above", severity="info"),
    Phrases("padded-intro", ("in recent years", "in today's world", "since the dawn of time", "it goes without saying", "we live in a world"), (1, 1, 2), where="opening", severity="info"),
    Phrases("cold-open", ("imagine a world", "what if i told you", "picture this", "let's face it"), (1, 2, 3), where="opening", severity="info"),
    Phrases("closing-cliche", ("hope this helps", "thanks for reading", "only time will tell", "the future is bright"), (1, 1, 2), where="closing", severity="info"),
    Phrases("closing-exhortation", ("you've got this", "happy baking", "happy coding", "keep going", "never stop learning"), (1, 2, 3), where="closing", severity="info"),
    Phrases("common-opener", ("the", "in", "of"), (5, 10, 20), where="start", kind="above", severity="info"),
)

#: Pairs of ways to write.
FORMS = (
    Forms("ellipsis-consistency", r"\.\.\.", "…"),
    Forms("number-style-consistency", r"\b[0-9]{1,3}(?:,[0-9]{3})+\b", r"\b[1-9][0-9]{3,}\b"),
    Forms("range-notation-consistency", "[0-9] ?– ?[0-9]", r"[^0-9-][0-9]{1,3}-[0-9]{1,3}[^0-9-]"),
    Forms("unit-spacing-consistency", r"\b[0-9]+ (?:GB|MB|kg|km|cm|mm|ms)\b", r"\b[0-9]+(?:GB|MB|kg|km|cm|mm|ms)\b"),
    Forms("currency-notation-consistency", r"\$[0-9]", r"\bUSD ?[0-9]"),
    Forms("date-format-consistency", r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b", r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4}\b"),
    Forms("amount-scale-consistency", r"\$[0-9.]+ (?:million|billion)\b", r"\$[0-9]{1,3}(?:,[0-9]{3}){2,}"),
    Forms("quote-style-consistency", "[\"']", "[“”‘’]", (1, 1, 3), "least", "en"),
    Forms("sentence-spacing-consistency", r"[.!?] \p{Lu}", r"[.!?]  \p{Lu}", (1, 1, 3), "least", "en"),
    Forms("oxford-comma-consistency", r"\p{L}+, \p{L}+, (?:and|or) \p{L}+", r"\p{L}+, \p{L}+ (?:and|or) \p{L}+", (3, 2, 1), "count", "en"),
    Forms("contraction-consistency", r"\b(?:don't|can't|won't|isn't|doesn't)\b", r"\b(?:do not|cannot|will not|is not|does not)\b", (4, 2, 1), "count", "en"),
    Forms("which-that-consistency", r"\p{L} which \p{L}", r"\p{L} that \p{L}", (4, 2, 1), "count", "en"),
    Forms("citation-style-mix", r"\[[0-9]+\]", r"\(\p{Lu}\p{L}+,? [12][0-9]{3}\)", (3, 2, 1), "count"),
    Forms("bare-url-mix", r"[^(\[<\"]https?://", r"\]\(https?://", (2, 3, 5), "count"),
    Forms("person-consistency", r"\b(?:[Yy]ou|[Yy]our)\b", r"\b(?:[Oo]ne's|[Tt]he reader)\b", (30, 20, 10), "share", "en"),
    Forms("spelling-consistency", r"\b(?:color|favor|center|organize|analyze|behavior)\p{Ll}*\b", r"\b(?:colour|favour|centre|organise|analyse|behaviour)\p{Ll}*\b", lang="en"),
    Forms("shell-prompt-mix", r"(?m)^\$ \p{Ll}", r"(?m)^(?:npm|git|pip|cd|curl|sudo) ", (3, 2, 1), "count"),
    Forms("list-marker-mix", r"(?m)^ *- ", r"(?m)^ *\* ", (49, 49, 49)),
    Forms("heading-end-punctuation-mix", r"(?m)^#+ [^\n]*[^:.\n]$", r"(?m)^#+ [^\n]*[:.]$", (49, 34, 20)),
    Forms("code-fence-language-mix", r"(?m)^```\p{L}", r"(?m)^```\n\p{L}", (3, 2, 1), "count"),
    Forms("kutoten-consistency", "[、。]", "[，．]", (1, 1, 3), "least"),
    Forms("bracket-width-consistency", r"[()]", "[（）]", (1, 1, 3), "least"),
    Forms("exclamation-width-consistency", r"[\p{Han}\p{Hiragana}\p{Katakana}][!?]", "[！？]", (1, 1, 3), "least"),
    Forms("fullwidth-alnum-consistency", "[A-Za-z0-9]", "[Ａ-Ｚａ-ｚ０-９]"),
    Forms("latin-spacing", r"[\p{Han}\p{Hiragana}\p{Katakana}] [A-Za-z]", r"[\p{Han}\p{Hiragana}\p{Katakana}][A-Za-z]", (1, 1, 3), "least"),
    Forms("katakana-long-vowel", "コンピューター|サーバー|ユーザー|フォルダー", "(?:コンピュータ|サーバ|ユーザ|フォルダ)(?:[^ー]|$)", (1, 1, 3), "least"),
    Forms("no-mixed-desumasu", "(?:です|ます|でした|ました)。", "(?:である|だ|だった|った)。", (5, 3, 1), "count"),
    Forms("missing-final-period", r"(?m)。$", r"(?m)[\p{Hiragana}\p{Katakana}\p{Han}]$", (34, 25, 15)),
    Forms("comma-space-form", r"\p{L}, \p{L}", r"\p{L},\p{L}", (49, 34, 20)),
    Forms("exclamation-form", r"[^!]![^!]", "!!+", (49, 34, 20)),
)


#: Rules whose every match holds a character beyond ASCII.
WIDE = ("invisible-character", "hankaku-kana", "lookalike-character", "emoji-density", "no-em-dash", "url-run-on", "no-nakaguro-parallel", "max-kanji-continuous", "max-ten", "connective-hierarchy")

_JAPANESE = "japanese"
#: What every match holds one of, so that a text without it is not searched: literals, or a letter of a Japanese
#: script. Keys are a rule's name, for pairs with the number of the form.
NEEDS: dict[str, tuple[str, ...]] = {
    "doubled-punctuation": (",,", ";;", ",.", ";,", ",;", ".,", ".;"),
    "impossible-time": (":", "AM", "PM"),
    "chat-citation-residue": ("utm_source", "contentReference", "oaicite", "【"),
    "share-over-hundred": ("% of ",),
    "url-run-on": ("://",),
    "space-before-punctuation": (" .", " ,", " ;", " ?", " !"),
    "hyphen-as-dash": (" - ", "--"),
    "q-fragment-answer": ("?",),
    "latin-abbreviation-form": ("e.g", "i.e", "eg. ", "ie. "),
    "vague-figure-reference": ("below", "above"),
    "no-em-dash": ("—",),
    "bold-density": ("**",),
    "unrendered-emphasis": ("**",),
    "no-nakaguro-parallel": ("・",),
    "max-kanji-continuous": (_JAPANESE,),
    "max-ten": ("、",),
    "connective-hierarchy": ("並びに", "若しくは"),
    "repeated-exclamation": ("!!",),
    "number-style-consistency/1": (",",),
    "range-notation-consistency/1": ("–",),
    "range-notation-consistency/2": ("-",),
    "currency-notation-consistency/1": ("$",),
    "currency-notation-consistency/2": ("USD",),
    "date-format-consistency/1": ("-",),
    "amount-scale-consistency/1": ("$",),
    "amount-scale-consistency/2": ("$",),
    "citation-style-mix/1": ("[",),
    "citation-style-mix/2": ("(",),
    "bare-url-mix/1": ("://",),
    "bare-url-mix/2": ("](http",),
    "shell-prompt-mix/1": ("$ ",),
    "heading-end-punctuation-mix/1": ("#",),
    "heading-end-punctuation-mix/2": ("#",),
    "code-fence-language-mix/1": ("```",),
    "code-fence-language-mix/2": ("```",),
    "exclamation-width-consistency/1": (_JAPANESE,),
    "exclamation-width-consistency/2": ("！", "？"),
    "latin-spacing/1": (_JAPANESE,),
    "latin-spacing/2": (_JAPANESE,),
    "katakana-long-vowel/1": (_JAPANESE,),
    "katakana-long-vowel/2": (_JAPANESE,),
    "no-mixed-desumasu/1": ("。",),
    "no-mixed-desumasu/2": ("。",),
    "missing-final-period/1": ("。",),
    "missing-final-period/2": (_JAPANESE,),
    "exclamation-form/1": ("!",),
    "exclamation-form/2": ("!!",),
}


@dataclass
class Settings:
    """The level of every rule: an explicit one, else `level`; `off` drops the rule, and not_run says so."""

    level: str = "normal"
    rules: dict[str, str] = field(default_factory=dict)

    def limit(self, rule: str, limits: tuple[float, float, float]) -> float | None:
        level = self.rules.get(rule, self.level)
        return None if level == "off" else limits[LEVELS.index(level)]
