"""Regular-expression rules, the default set, and the texts of all messages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import PySparkException

FIRST_RULE_ID = 1000
#: Severities from here on are errors.
ERROR_SEVERITY = 5
#: A dot matches line ends, $ only the very end or a last line feed, and classes are Unicode's.
FLAGS = "(?sdU)"


@dataclass(frozen=True)
class Rule:
    pattern: str
    message: str
    severity: int
    match_is_problem: bool = True
    show_match: bool = False
    id: int = 0

    @property
    def level(self) -> str:
        return "Error" if self.severity >= ERROR_SEVERITY else "Warning"


@dataclass(frozen=True)
class RuleSet:
    header: tuple[Rule, ...] = ()
    name: tuple[Rule, ...] = ()
    description: tuple[Rule, ...] = ()
    sequence: tuple[Rule, ...] = ()

    def all(self) -> tuple[Rule, ...]:
        return self.header + self.name + self.description + self.sequence

    def with_rule(self, kind: str, rule: Rule) -> RuleSet:
        """The rules and one more of a class (header, name, description or sequence), with the next free id."""
        number = max((r.id + 1 for r in self.all()), default=FIRST_RULE_ID)
        return replace(self, **{kind: (*getattr(self, kind), replace(_checked(rule, number), id=number))})


def _checked(rule: Rule, number: int) -> Rule:
    """``rule`` if its pattern is one; patterns run in the JVM, so it is asked where there is one."""
    if context := SparkContext._active_spark_context:
        try:
            context._jvm.java.util.regex.Pattern.compile(FLAGS + rule.pattern)
        except (Py4JJavaError, PySparkException) as problem:
            raise ValueError(f"rule {number}, {rule.pattern!r}: {problem}") from problem
    else:
        try:
            re.compile(rule.pattern)
        except re.error as problem:
            raise ValueError(f"rule {number}, {rule.pattern!r}: {problem}") from problem
    return rule


def numbered(**classes: list[Rule]) -> RuleSet:
    """The rules with ids from ``FIRST_RULE_ID`` on, in the order of the classes; invalid patterns are refused."""
    number, out = FIRST_RULE_ID, {}
    for kind in ("header", "name", "description", "sequence"):
        made = []
        for rule in classes.get(kind, []):
            made.append(replace(_checked(rule, number), id=number))
            number += 1
        out[kind] = tuple(made)
    return RuleSet(**out)


def default_rules(allow_asterisk: bool = False, allow_dash: bool = False, allow_all_symbols: bool = False) -> RuleSet:
    # Patterns, messages and severities. Fixed values.
    more = r"!@$%^&*<>?,\\" if allow_all_symbols else ""
    header = [
        Rule(r"^>[ \t]*$", "Line starts with > but does not contain a protein name", 7),
        Rule(r"^>[ \t].+", "Space or tab found directly after the > symbol", 7),
        Rule(r"^>[^ \t]+[ \t]*$", "Line contains a protein name, but not a description", 3),
        Rule(r"^>[^ \t]+\t", "Protein name is separated from the protein description by a tab", 3),
        Rule(r"^>[^ \t]+\xA0", "Non-breaking space after the protein name", 3),
        Rule(r"^>[^ \t\xFFFD]+\xFFFD", "Unicode replacement character (possibly a non-breaking space) after the protein name", 3),
    ]
    name = [
        Rule(rf"[^A-Za-z0-9.\-_:,|/()\[\]\=\+#{more}]", "Protein name contains invalid characters", 7, show_match=True),
        Rule(r"[:|].*?[:|;].*?[:|;]", "Protein name contains 3 or more vertical bars", 4, show_match=True),
    ]
    if not allow_all_symbols:
        name.append(Rule(r"[/()\[\],]", "Protein name contains undesirable characters", 3, show_match=True))
    description = [
        Rule(r'"', "Protein description contains a quotation mark", 3),
        Rule(r"\t", "Protein description contains a tab character", 3),
        Rule(r"\\/", r"Protein description contains an escaped slash: \/", 3),
        Rule(r"[\x00-\x08\x0E-\x1F]", "Protein description contains an escape code character", 7),
        Rule(r".{900,}", "Protein description is over 900 characters long", 4),
    ]
    sequence = [Rule(r"[ \t]", "A space or tab was found in the residues", 7)]
    if not allow_asterisk:
        sequence.append(Rule(r"\*", "An asterisk was found in the residues", 7))
    if not allow_dash:
        sequence.append(Rule(r"\-", "A dash was found in the residues", 7))
    sequence += [
        Rule(r"[^A-Z \t\*\-]", "Invalid residues found", 7, show_match=True),
        Rule("B", "Residues line contains B (non-standard amino acid for N or D)", 2),
        Rule("J", "Residues line contains J (non-standard amino acid)", 2),
        Rule("O", "Residues line contains O (non-standard amino acid, ornithine)", 2),
        Rule("U", "Residues line contains U (non-standard amino acid, selenocysteine)", 3),
        Rule("X", "Residues line contains X (non-standard amino acid for L or I)", 2),
        Rule("Z", "Residues line contains Z (non-standard amino acid for Q or E)", 2),
    ]
    return numbered(header=header, name=name, description=description, sequence=sequence)


# Codes of the structural checks, with their messages. Fixed values.
MESSAGES = {
    0: "Unspecified error",
    1: "Protein name is longer than the maximum allowed length of {max_name} characters",
    2: "Found a line starting with a space",
    6: "A blank line was found between the protein name and its residues",
    7: "A blank line was found in the middle of the residue block for the protein",
    8: "Residues were found, but a protein header didn't precede them",
    9: "File does not contain any protein entries",
    10: "The last entry in the file is a protein header line, but there is no protein sequence line after it",
    11: "File does not end in a blank line; this is a problem for SEQUEST",
    12: "Duplicate protein name found",
    13: "Protein name is shorter than the minimum suggested length of {min_name} characters",
    15: "Blank line found before the protein name; this is acceptable, but not preferred",
    17: "Residues line is longer than the suggested maximum length of {max_residues} characters",
    18: "Duplicate protein sequences found",
    19: "Renamed protein because duplicate name",
    20: "Removed protein since duplicate sequence",
    21: "Duplicate protein retained in fixed file",
    22: "Residues are likely DNA instead of amino acids",
}


def messages(options) -> dict[int, str]:
    """Every code's text under the options, rules included."""
    limits = {"max_name": options.max_name_length, "min_name": options.min_name_length, "max_residues": options.max_residues_per_line}
    return {k: v.format(**limits) for k, v in MESSAGES.items()} | {r.id: r.message for r in options.rule_set.all()}


# Sections of the XML files for the classes of rules. Fixed values.
XML_SECTIONS = {"header": "ValidateFastaHeaderLineRules", "name": "ValidateFastaProteinNameRules", "description": "ValidateFastaProteinDescriptionRules", "sequence": "ValidateFastaProteinSequenceRules"}


def load_rules(sections: dict[str, dict[str, str]]) -> RuleSet | None:
    """The rules of an XML file; None if it has no section for them."""
    classes: dict[str, list[Rule]] = {}
    for kind, section in XML_SECTIONS.items():
        if section not in sections:
            continue
        items, classes[kind] = sections[section], []
        for i in range(1, int(items.get("RuleCount", 0) or 0) + 1):
            get = lambda key, default, i=i: items.get(f"Rule{i}{key}", default)
            if pattern := get("MatchRegEx", ""):
                classes[kind].append(Rule(pattern, get("MessageWhenProblem", f"Error found with RegEx {pattern}"), int(get("Severity", "3")), get("MatchIndicatesProblem", "True").lower() == "true", get("DisplayMatchAsExtraInfo", "False").lower() == "true"))
    return numbered(**classes) if classes else None


def save_rules(rules: RuleSet, root: ET.Element) -> None:
    for kind, section in XML_SECTIONS.items():
        node, own = ET.SubElement(root, "section", name=section), getattr(rules, kind)
        ET.SubElement(node, "item", key="RuleCount", value=str(len(own)))
        for i, rule in enumerate(own, 1):
            for key, value in (("MatchRegEx", rule.pattern), ("MatchIndicatesProblem", rule.match_is_problem), ("MessageWhenProblem", rule.message), ("Severity", rule.severity), ("DisplayMatchAsExtraInfo", rule.show_match)):
                ET.SubElement(node, "item", key=f"Rule{i}{key}", value=str(value))
