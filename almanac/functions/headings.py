"""Patterns of headings and table headers in course outlines."""

from __future__ import annotations

# Headings of the evaluation section; the first pattern is the specific one.
EVALUATION_SPECIFIC = r"(?:Evaluation|Examination|Assessment)[ /]+(?:Schemes?(?: and Schedule)?|Schedule|Pattern|Components?|Grading|Plan|Criteria)(?=[ \t]*(?::|\(|\*|\.|$|[ \t]{2,}Duration))"
EVALUATION_BARE = r"Evaluation(?=[ \t]*(?::|$))"
SCOPE = r"Scope\s*(?:and|&)\s*Objectives?(?: of (?:the |this )?Course)?"
DESCRIPTION = r"Course Description"
ATTENDANCE = r"Attendance(?: Policy)?"
MAKEUP = r"Make[-\s]*up Policy"

# Headings that end a section.
SECTIONS = [
    DESCRIPTION, SCOPE, r"Course Learning Outcomes?", r"Text\s*Books?", r"Reference(?: Books?|s)?", r"Course Plan", r"Lecture Plan", r"Lab Manual",
    r"Academic Conduct Policy", r"Grading Policy", r"Criterion for NC(?: and Grading Policy)?", r"NC Criteria", r"Chamber Consultation(?: Hours?)?",
    r"Instructor Consultation", MAKEUP, r"Attendance Policy", r"Attendance(?=[ \t]*(?::|$))", r"(?:Course )?Notices?", r"Announcements?(?: and Notices)?",
    r"Others", r"Notes?(?:\s*\(if any\))?", r"(?:Office |Chamber )?Consultation Hours?", r"List of Experiments", r"General", r"Academic Honesty",
    r"Disciplinary Policy", r"Malpractices", r"NC Criterion", r"Important Note", r"Mid[- ]semester [Gg]rading", r"Grading Procedure",
    r"Minimum (?:Passing|Criteria|criterion)", r"Important Course Policies", r"Prerequisites", r"Pre-requisites", r"Office consultation",
    r"Mid[- ]Semester Evaluation", r"Marks Distribution", r"Reading assignments", r"Open Book Policy", r"Lab(?=:[ \t])", r"Labs(?=:[ \t])",
    r"Project(?=:[ \t])", r"Assignments?\(s\)(?=:[ \t])", r"Course Outcomes", r"Learning Outcomes",
]
NUMBERING = r"(?:\d+(?:\.\d+)*[.):][ \t]*|\d+[ \t]+|[IVX]+[.)][ \t]*)?"
SIGNATURE = r"^[ \t]*\(?Instructor[- \t]*in[- \t]*charge(?:[ \t,()]*(?:[A-Z]{2,8}[ \t]*[A-Z]\d{3})?\)?)[ \t]*$"

# Headers of the columns with weights or marks.
WEIGHT_HEADER = r"(?:Weight(?:age|ag|s)?|Weitage|Weighatge|Weigh(?=\b)|Wt(?:g)?\.?|Percentage)\b"


def start(heading: str) -> str:
    return rf"^[ \t]*{NUMBERING}(?:{heading})\b[ \t]*:?[ \t]*"


def end(evaluation: bool = False) -> str:
    names = SECTIONS if evaluation else [*SECTIONS, EVALUATION_SPECIFIC, EVALUATION_BARE]
    return rf"^[ \t]{{0,24}}{NUMBERING}(?:{'|'.join(names)})\b|{SIGNATURE}"
