"""Closed word classes as data: French by default, replaceable by the caller."""

from __future__ import annotations

#: Words that carry no content, by initial letter.
STOPWORDS = frozenset(
    " ".join(
        (
            "a aussi au aux avec avoir à",
            "c ce ces cela cette chez comme",
            "ça",
            "d dans de depuis des du",
            "elle en entre est et eux être",
            "il ils j je",
            "l la le les leur lui",
            "m ma mais me mes moi mon même",
            "n ne nos notre nous",
            "on ont ou où",
            "par pas pendant plus pour",
            "qu que qui",
            "s sa se ses si sont son sur",
            "t ta te tes toi ton très tu",
            "un une vers vos votre vous y",
        )
    ).split()
)
#: Words that negate the next content word.
NEGATORS = frozenset(("aucun", "aucune", "jamais", "never", "ni", "no", "non", "not", "pas", "sans", "without"))
#: Words of a query after which terms are unwanted, and words that keep the sign.
EXCLUDERS = frozenset(("excepte", "excepté", "hormis", "ni", "pas", "sans", "sauf"))
JOINERS = frozenset(("avec", "et", "ou", "plus"))
