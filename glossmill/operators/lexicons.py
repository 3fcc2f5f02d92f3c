"""Word lists. Fixed values that results depend on, in the order and spelling they are published in."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Term:
    lexicon: str
    term: str
    tier: int
    category: str


def _terms(lexicon: str, tier: int, category: str, terms: list[str]) -> list[Term]:
    return [Term(lexicon, t, tier, category) for t in terms]


# Dehumanising terms by category and tier.
DEHUMANISATION = [
    *_terms("dehum", 1, "mass_metaphor", [
        "flood", "flooded", "flooding", "flooded in", "floodgates", "open the floodgates", "swarm", "swarming", "hordes", "horde", "wave",
        "waves", "invasion", "invading", "invaders", "tide", "tidal", "influx", "inundated", "inundation", "surge", "swamped", "overwhelm",
        "overwhelming", "overwhelmed", "overrun", "overrunning", "deluge", "onslaught", "besieged", "pouring in", "poured in", "flocking",
        "mass migration", "mass immigration", "open door", "open borders",
    ]),
    *_terms("dehum", 1, "criminalisation", [
        "illegal immigrant", "illegal immigrants", "illegal migrant", "illegal migrants", "illegal migration", "illegal entry",
        "illegal entrant", "illegal entrants", "illegal asylum", "illegal alien", "illegal aliens", "illegals", "bogus", "bogus asylum",
        "sneak", "sneaked", "sneaking", "sham marriage", "sham marriages", "fake passport", "fake passports", "forged documents",
        "clandestine", "smuggled", "smuggling", "smugglers", "people smuggling", "people smugglers", "criminal gangs", "gang", "gangs",
        "trafficked", "trafficking", "crackdown",
    ]),
    *_terms("dehum", 1, "burden_framing", [
        "burden", "burdens", "scrounger", "scroungers", "sponger", "spongers", "taxpayer", "taxpayers", "handout", "handouts",
        "health tourism", "health tourist", "health tourists", "benefit tourist", "benefit tourists",
    ]),
    *_terms("dehum", 2, "threat_framing", [
        "crisis", "threat", "threats", "strain", "unsustainable", "uncontrolled", "out of control", "dangerous individual",
        "dangerous individuals", "dangerous person", "dangerous people", "dangerous criminal", "dangerous criminals", "dangerous foreign",
    ]),
]

# Terms of moral outrage by category.
OUTRAGE = [
    *_terms("outrage", 1, "moral_condemnation", [
        "shame", "shameful", "shameless", "shaming", "disgrace", "disgraceful", "disgraced", "outrage", "outrageous", "outrageously",
        "appalling", "appalled", "scandalous", "scandal", "unacceptable", "reprehensible", "repugnant", "unconscionable", "inhumane",
        "inhuman", "immoral", "morally wrong", "morally bankrupt", "moral failure", "moral outrage", "criminal behaviour", "criminal act",
        "criminal acts", "criminal conduct", "criminal exploitation", "criminal element", "threat to our", "threat to this",
        "threat to national", "existential threat", "absurd", "travesty",
    ]),
    *_terms("outrage", 1, "institutional_shame", [
        "betrayal", "betrayed", "betraying", "broken system", "broken promise", "broken promises", "deception", "deceptive", "deceit",
        "downright lies", "spreading lies", "telling lies", "these lies", "those lies", "lied", "fiasco", "farce", "shambles",
    ]),
    *_terms("outrage", 1, "outrage_intensifier", [
        "unprecedented", "deeply troubling", "deeply concerned", "deeply worrying", "deeply alarming", "deeply shameful",
        "gravely concerned", "utterly", "wholly unacceptable", "simply unacceptable", "morally unacceptable", "staggering", "shocking",
        "damning",
    ]),
    *_terms("outrage", 1, "tabloid_outrage", [
        "fury", "furious", "slammed", "blasted", "backlash", "uproar", "chaos", "chaotic", "catastrophe", "catastrophic", "disastrous",
        "madness", "lunacy",
    ]),
]

# Markers of modality and pronouns.
CERTAINTY = [
    "will", "must", "shall", "definitely", "certainly", "inevitably", "undoubtedly", "absolutely", "clearly", "obviously", "always",
    "necessarily",
]
HEDGING = [
    "might", "could", "perhaps", "possibly", "probably", "arguably", "seemingly", "potentially", "presumably", "apparently", "likely",
    "unlikely", "sometimes", "often",
]
AMBIGUOUS = ["may", "would"]
NOT_EPISTEMIC = ["will"]
INGROUP = [
    "we", "us", "our", "ours", "ourselves",
]
OUTGROUP = [
    "they", "them", "their", "theirs", "themselves",
]
TITLES = [
    "mr", "mrs", "ms", "miss", "dr", "prof", "hon", "right", "secretary", "minister", "theresa", "prime",
]

# Keywords that an article must have one of.
KEYWORDS = [
    "immigration", "asylum", "migrants", "refugees", "borders", "migration", "migrant", "refugee", "border", "immigrant",
]

#: Words that occur in the synthetic tables, where the lists above hardly do.
PROBE = [*_terms("probe", 1, "function_word", ["the", "of", "and", "to", "in", "is", "that", "it", "for", "with"]), *_terms("probe", 2, "insult", ["idiot"]), *_terms("probe", 2, "phrase", ["licensed under", "of the"])]
