"""Fixed values the features and grids are defined by."""

from __future__ import annotations

# English stop words, compared after accents are stripped.
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them "
    "their theirs themselves what which who whom this that that'll these those am is are was "
    "were be been being have has had having do does did doing a an the and but if or because "
    "as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don don't should should've now d ll m o re ve y "
    "ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven "
    "haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# Ordered text replacements (e-mail, @mention, whitespace, URL, '#').
# A run of non-blanks holding '@' is matched from its start, which keeps the
# first pattern linear on long runs.
REPLACEMENTS = [
    (r"(?U)(?<!\S)\S*@\S*\s?", " "),
    (r"(?U)@\S+", " "),
    (r"(?U)\s+", " "),
    (r"(?U)http\S+", " "),
    (r"#", " "),
]

# Text that every match of a replaced pattern holds: most posts are without it.
HELD = {
    REPLACEMENTS[0][0]: "@", REPLACEMENTS[1][0]: "@", REPLACEMENTS[3][0]: "http",
    REPLACEMENTS[4][0]: "#",
}

# Phrase lists of the lookup features.
PHRASES = {
    "exclem": ["!"],
    "question": ["?"],
    "termspos": ["great", "like", "excellent", "rock on"],
    "termsneg": ["suck", "fuck", "fail", "eww"],
    "emopos": [":-)", ":)", ";-)"],
    "emoneg": [":-(", ":("],
}

# Tag rule of tokens: length bounds (fixed values).
TOKEN_LENGTH = (1, 60)

# Most terms a dictionary keeps (fixed value).
KEEP_TERMS = 100_000

# The two learner grids and their searches.
ALL_KERNELS = ["linear", "poly", "rbf", "sigmoid"]
GRID_SMALL = {
    "kernels": ALL_KERNELS,
    "params": {"cost": [1], "gamma": [0.1], "coef0": [10], "degree": [2, 3]},
    "inner": 5,
    "dynamic": ["lda_hashtags"],
}
GRID_FULL = {
    "kernels": ALL_KERNELS,
    "params": {"cost": [1, 10], "gamma": [0.01, 1], "coef0": [0, 10], "degree": [2, 3]},
    "inner": 5,
    "dynamic": ["hashtags", "lda_hashtags", "full_text"],
}

# Fold-fitted features and their parameter lists.
DYNAMIC_FEATURES = {
    "bow_text": {"type": "bow", "params": {"no_below": [10], "no_above": [0.5]}},
    "terms_text": {"type": "terms", "params": {"no_below": [10], "no_above": [0.5]}},
    "hashtags": {
        "type": "community",
        "params": {"community_graph_type": ["weighted"], "community_feature_type": ["weighted"]},
    },
    "lda_hashtags": {
        "type": "lda",
        "params": {
            "no_below": [1],
            "no_above": [1],
            "LDA_topic_cutoff_threshold": [0],
            "LDA_num_topics": [20],
        },
    },
    "full_text": {
        "type": "lda",
        "params": {
            "no_below": [1],
            "no_above": [1],
            "LDA_topic_cutoff_threshold": [0],
            "LDA_num_topics": [20],
        },
    },
}
