"""Fixed values of the charge model."""

# Result texts the analyses ask for.
DISMISSED = "Dismissed"
CONVICTED = "Convicted"
DIVERSION = "Diversion"
HELD_TO_ANSWER = "Held To Answer in Superior Court"

# Names of the five record parts.
PART_NAMES = {
    "part1": "juvenile_motion_to_transfer",
    "part3": "juvenile_misdemeanors",
    "part4": "juvenile_felonies",
    "part5": "adult_misdemeanors",
    "part6": "adult_felonies",
}
ADULT_PARTS = ("adult_misdemeanors", "adult_felonies")

# Plea codes and their texts.
PLEA_TEXTS = {
    "DA": "Denies allegations",
    "IN": "Not guilty by reason of insanity",
    "NC": "Nolo contendere",
    "NE": "Not guilty entered by court",
    "NG": "Not guilty",
    "NI": "Not guilty and not guilty by reason of insanity",
    "PG": "Plead guilty",
}

# Low-level charges added by hand to the include rules.
LOW_LEVEL_PATTERNS = ("14601", "485", "422", "592.2", "490.2")
LOW_LEVEL_CODES = ("PC_485&490.2",)

# Texts for frequent charges the code table has no row for.
HAND_ENTERED_OFFENCES = {
    "HS_11364_M": "misd. paraphernalia -- HS_11364_M",
    "HS_11377_M": "misd. cont. sub. poss. -- HS_11377_M",
    "VC_12500(A)_I": "infr. drive w/o license -- VC_12500(A)_I",
    "PC_484(A)&490.2_M": "misd. petty theft: - $950 -- PC_484(A)&490.2_M",
    "PC_594(A)_M": "misd. vandalism property -- PC_594(A)_M",
    "VC_16028(A)_I": "infr. driving w/o insurance -- VC_16028(A)_I",
    "HS_11350_M": "broadly misd. possession (narcotic, MECLOQUALONE/METHAQUALONE/ETC) -- HS_11350_M",
    "HS_11377_F": "fel. possess controlled subst. HS_11377_F",
}

# Short offence texts of the diversion figure.
DIVERSION_FIGURE_TEXTS = {
    "misd. cont. sub. poss. -- HS_11377_M": "Possess controlled substance \n HS 11377",
    "misd. paraphernalia -- HS_11364_M": "Paraphernalia possession \n HS 11364",
    "broadly misd. possession (narcotic, MECLOQUALONE/METHAQUALONE/ETC) -- HS_11350_M": "Possess narcotic \n HS 11350",
    "use/under influence of controlled substance -- HS_11550(A)_M": "Use of a controlled substance \n HS 11550(a)",
    "dui alcohol -- VC_23152(A)_M": "DUI \n VC 23152(a)",
}

# Charge-type figure, in drawing order: type, display text, colour group.
CHARGE_TYPES = (
    ("felonies", "Felonies", "A"),
    ("misdemeanors", "Misdemeanors", "A"),
    ("infractions", "Infractions", "A"),
    ("serious_or_violent", "Serious or Violent Felonies \n (adults only)", "B"),
    ("low_level", "Decline to charge or \n pre-plea diversion  ", "B"),
)

# Outcome classes, in drawing order: result text, display text.
OUTCOME_CLASSES = (
    (DISMISSED, "Dismissed"),
    (CONVICTED, "Convicted"),
    (None, "Other"),
    (HELD_TO_ANSWER, "Held To Answer \n in Superior Court"),
    (DIVERSION, "Diversion"),
)

# Codes and patterns the analyses single out.
FREQUENT_MISDEMEANORS = ("M_HS_11364", "M_VC_14601.1(A)", "M_HS_11377")
DECLINABLE_PATTERNS = ("11364", "12500", "11377")
DECLINABLE_CODES = ("M_VC_14601.1(A)",)
TRESPASS_PATTERN = "tres"
THREAT_PATTERN = "422"
ASSAULT_CODE = "PC_245(A)(4)"
PROGRAM_PARTICIPANTS = 971
