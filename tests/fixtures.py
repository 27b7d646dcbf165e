"""Small artifacts, retyped as triples, with what the gate should say about them."""

from quercus import schema as S
from quercus.sources.kernel import KERNEL_NS

UP = S.UPPER_PREFIX
EX = "http://ex/cases#"


def cls(iri, *parents, label=None):
    out = [(iri, S.TYPE, S.CLASS)] + [(iri, S.SUBCLASS, p) for p in parents]
    return out + ([(iri, S.LABEL, label)] if label else [])


HEADER = [("http://ex/cases", S.TYPE, S.owl("Ontology"))]
COHERENT = (
    HEADER + cls(UP + "0000040", label="material entity") + cls(UP + "0000019")
    + cls(EX + "Wing", UP + "0000040", label="Wing") + cls(EX + "Mass", UP + "0000019")
)
STRADDLE = HEADER + cls(UP + "0000019") + cls(UP + "0000016") + cls(EX + "Force", UP + "0000019", UP + "0000016", label="Force")
GOOD = HEADER + [
    t
    for name, parent in (
        ("PaymentNorm", "Norm"), ("SignContractObligation", "Obligation"), ("ContractValidity", "LegalEffect"),
        ("DriverRole", "Role"), ("PersonAgent", "Agent"), ("SigningEvent", "LegalEvent"), ("ContractDispute", "Contradiction"),
    )
    for t in cls(EX + name, KERNEL_NS + parent, label=name)
] + [
    (EX + "realizedByAgent", S.TYPE, S.OBJECT_PROPERTY),
    (EX + "realizedByAgent", S.LABEL, "realized by agent"),
    (EX + "realizedByAgent", S.DOMAIN, EX + "DriverRole"),
    (EX + "realizedByAgent", S.RANGE, EX + "PersonAgent"),
    (EX + "alice", S.TYPE, EX + "PersonAgent"),
    (EX + "aliceDriver", S.TYPE, EX + "DriverRole"),
    (EX + "aliceDriver", EX + "realizedByAgent", EX + "alice"),
    (EX + "dispute", S.TYPE, EX + "ContractDispute"),
]
BAD = HEADER + [
    t
    for name in ["AbsenceOfRecognition", "LackOfConsideration", "NormAlignmentWithRuleOfRecognition"]
    + [f"Class{i:03d}" for i in range(200)]
    for t in cls(EX + name)
]
BARE = [t for i in range(3) for t in cls(f"http://ex/Empty{i}")]
ALL = {"coherent": COHERENT, "straddle": STRADDLE, "good": GOOD, "bad": BAD, "bare": BARE}
# classes, subClassOf, objectProperties, objectPropertyAxioms, dataProperties, individuals, axioms
COUNTS = {
    "coherent": (4, 2, 0, 0, 0, 0, 2),
    "straddle": (3, 2, 0, 0, 0, 0, 2),
    "good": (7, 7, 1, 3, 0, 3, 13),
    "bad": (203, 0, 0, 0, 0, 0, 0),
    "bare": (3, 0, 0, 0, 0, 0, 0),
}
