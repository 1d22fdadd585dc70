"""Small record files in the shapes the readers expect."""

from __future__ import annotations

from pathlib import Path

HTA = "Held To Answer in Superior Court"

PART_HEADER = (
    "Masked Case No,Defendant No,Case Type,Case Level,Sex,Age At Time Of Crime,Charge Level,"
    "Count No,Code,Section,Plea,Result,Result Description,Result Date,Charge City,Minor Zip Code"
)

# case, defendant, case level, age, level, code, section, plea, result, city, zip
ADULT_MISDEMEANORS = [
    ("1", "1", "M", "30", "M", "PC", "594(A)", "NG", "Dismissed", "", "90012-1234"),
    ("1", "1", "M", "30", "M", "HS", "11364", "PG", "Convicted", "", ""),
    ("1", "2", "M", "18", "M", "VC", "14601.1(A)", "NC", "Diversion", "LA", "90013"),
    ("2", "1", "M", "25", "I", "PC", "602(M)", "XX", "Dismissed", "", ""),
    ("2", "1", "M", "25", "I", "", "#7028(A)(1)/04", "", "", "", ""),
]
ADULT_FELONIES = [
    # one charge, held and then convicted: the held row goes
    ("7", "1", "F", "26", "F", "PC", "422", "NG", HTA, "", ""),
    ("7", "1", "F", "26", "F", "PC", "422", "PG", "Convicted", "", ""),
    # held only, once: stays
    ("8", "1", "F", "90", "F", "PC", "245(A)(4)", "NG", HTA, "", ""),
    # held twice and nothing else: both go
    ("9", "1", "F", "91", "F", "PC", "211", "NG", HTA, "", ""),
    ("9", "1", "F", "91", "F", "PC", "211", "NI", HTA, "", ""),
    ("9", "2", "M", "", "F", "BP", "11320", "DA", "Acquitted", "", ""),
]
JUVENILE_FELONIES = [
    ("1", "1", "F", "10", "F", "PC", "484.1&490.2", "DA", "Dismissed", "", "90001"),
    ("3", "1", "F", "11", "F", "PC", "25850(A)", "DA", "Dismissed", "", "90001"),
]
JUVENILE_MISDEMEANORS = [
    ("4", "1", "M", "17", "M", "EC", "48454", "DA", "Diversion", "", "90002-0001"),
]
# part 1 has neither case type and level nor charge level and city
MOTIONS = [("5", "1", "16", "PC", "647.6(A)", "NG", "Dismissed", "90003", "Transfer")]


def _line(*cells: str) -> str:
    return ",".join(f'"{c}"' if "," in c else c for c in cells)


def _part(rows) -> list[str]:
    lines = [PART_HEADER]
    for number, (case, defendant, case_level, age, level, code, section, plea, result, city, zip_code) in enumerate(rows):
        lines.append(
            _line(case, defendant, "criminal", case_level, "X", age, level, str(number), code, section,
                  plea, "r", result, "2018-01-02 00:00:00", city, zip_code)
        )
    return lines


def _motions(rows) -> list[str]:
    lines = [
        "Masked Case No,Defendant No,Sex,Age At Time Of Crime,Count No,Code,Section,Plea,Result,"
        "Result Description,Result Date,Minor Zip Code,Case Category Description"
    ]
    for case, defendant, age, code, section, plea, result, zip_code, category in rows:
        lines.append(
            _line(case, defendant, "X", age, "1", code, section, plea, "r", result,
                  "2017-05-06 00:00:00", zip_code, category)
        )
    return lines


WOBBLER_LIST = ["charge", "BP_11320", "PC_594(A)"]

# Codes, actions and match types as rule lists spell them; the texts are invented.
# Blanks at the end, lower case, an unnamed last column, and one code both included and excluded.
RULE_LIST = [
    "Charge,Include,Type,Description,Match Type,",
    "NA #7028(A)(1)/04,Include,Subsection,,Exact,",
    "EC 48454,Include,Main statute,,Partial,",
    "HS 11364,Include,Main statute,an invented text,Partial,",
    'PC 602,Include,Main statute,"Invented, with a comma",Partial,',
    "PC 602(M),Exclude,Subsection,,Partial,",
    'PC 647 ,Include,Main statute,"Invented ""in quotes"", with a comma",Partial,',
    "PC 647.6,Exclude,Subsection,,Partial,",
    "PC 647(J),Exclude,Subsection,,Partial,",
    "PC 594 ,Include,Main statute,,Exact,",
    "PC 594(A),Include,Subsection,,Exact,",
    "PC 530.5,Include,Main statute,Invented ,Partial,",
    "PC 530.5(b),Exclude,Subsection,,Exact,",
    "PC 25850(a),Include,Main statute,,Exact,",
    "PC_484.1&490.2,Exclude,Subsection,,Exact,",
    "PC_484.1&490.2,Include,,Invented,Exact,",
]

SERIOUS_LIST = ["code_section,note", "F_PC_211,robbery", "F_PC_422,threat"]

# Two texts under one key, blanks inside the number, one key without a charge.
CODE_TABLE = [
    "1,0,0,M,11364,HS,PARAPHERNALIA,x",
    "2,0,0,F,422 ,PC,CRIMINAL THREATS,x",
    "3,0,0,F,4 22,PC,THREATS WITH INTENT,x",
    "4,0,0,I,602(M),PC,TRESPASS: OCCUPY PROPERTY,x",
    "5,0,0,M,999,PC,NA,x",
]


def write(folder: Path) -> dict[str, str]:
    """Write all files with Windows line ends and no last newline; returns their paths."""
    files = {
        "part1": _motions(MOTIONS),
        "part3": _part(JUVENILE_MISDEMEANORS),
        "part4": _part(JUVENILE_FELONIES),
        "part5": _part(ADULT_MISDEMEANORS),
        "part6": _part(ADULT_FELONIES),
        "wobblers": WOBBLER_LIST,
        "rules": RULE_LIST,
        "serious": SERIOUS_LIST,
        "code_table": CODE_TABLE,
    }
    paths = {}
    for name, lines in files.items():
        path = folder / f"{name}.csv"
        path.write_bytes("\r\n".join(lines).encode())
        paths[name] = str(path)
    return paths
