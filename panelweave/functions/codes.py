"""Code sets of the school census. They must equal the source's for right results."""

from __future__ import annotations

#: Stages of all eligible enrolments, and of competition levels I and II.
TOTAL_STAGES = (*range(8, 12), *range(19, 39), 41)
LEVEL_I_STAGES = (8, 9, 19, 20)
LEVEL_II_STAGES = (10, 11, 21, 41)

#: Stage one and two school years before.
ONE_YEAR_BACK = {41: 21, 11: 10, 21: 20, 10: 9, 20: 19, 9: 8}
TWO_YEARS_BACK = {41: 20, 11: 9, 21: 19, 10: 8, 20: 18, 9: 7}

#: Stages of a grade whose pupils' school of the year before is guessed, and its name.
GUESS_STAGES = {"ninth": (11, 41), "eighth": (10, 21), "seventh": (9, 20)}

#: Administrative dependency of private schools.
PRIVATE = 4

#: Synonyms of the five exam scores.
SCORE_SYNONYMS = {
    "score_cn": ("NU_NOTA_CN", "NOTA_CN", "NU_NT_CN"),
    "score_ch": ("NU_NOTA_CH", "NOTA_CH", "NU_NT_CH"),
    "score_lc": ("NU_NOTA_LC", "NOTA_LC", "NU_NT_LC"),
    "score_mt": ("NU_NOTA_MT", "NOTA_MT", "NU_NT_MT"),
    "score_essay": ("NU_NOTA_REDACAO", "NOTA_REDACAO", "NU_NT_REDACAO"),
}
