"""Fixed values of the domain: vocabulary, categories, specifications, classification, formats."""

from __future__ import annotations

#: Canonical phrase and the abbreviations that stand for it.
ABBREVIATIONS = {
    "hexagonal": ("hex", "hexa", "hx"),
    "bolt": ("blt", "bolts"),
    "nut": ("nt", "nuts"),
    "washer": ("wshr", "wsr"),
    "plain": ("pln",),
    "spring": ("spr", "sprg"),
    "stud": ("std bolt",),
    "stainless steel": ("ss", "s.s.", "st.steel", "stainless stl", "sst"),
    "carbon steel": ("cs", "c.s.", "carbon stl"),
    "mild steel": ("ms", "m.s.", "mild stl"),
    "cast iron": ("ci", "c.i."),
    "galvanised iron": ("gi", "g.i.", "galv iron"),
    "high tensile": ("ht", "h.t."),
    "gate valve": ("gt valve", "gate vlv", "gt vlv"),
    "globe valve": ("glb valve", "globe vlv"),
    "ball valve": ("bl valve", "ball vlv"),
    "check valve": ("chk valve", "nrv", "non return valve"),
    "valve": ("vlv", "vv"),
    "flanged": ("flgd", "flanged end"),
    "screwed": ("scrd", "threaded", "thd"),
    "bearing": ("brg", "bng", "bearings"),
    "gasket": ("gskt", "gsk"),
    "spiral wound": ("sp wound", "spiral wnd", "swg"),
    "compressed asbestos fibre": ("caf", "c.a.f."),
    "graphite": ("graph",),
    "seamless": ("smls", "s/less"),
    "schedule": ("sch", "sched"),
    "pipe": ("pp", "ppe"),
    "elbow": ("elb", "ell"),
    "flange": ("flg", "flng"),
    "weld neck": ("wn", "w/n"),
    "raised face": ("rf", "r/f"),
    "cable": ("cbl", "cab"),
    "core": ("c", "cr"),
    "armoured": ("armd", "arm"),
    "motor": ("mtr", "mot"),
    "induction": ("ind", "indn"),
    "foot mounted": ("b3", "foot mtd"),
    "flange mounted": ("b5", "flg mtd"),
    "centrifugal": ("centf", "cent"),
    "pump": ("pmp",),
    "impeller": ("imp", "impl"),
    "o-ring": ("oring", "o ring"),
    "nitrile": ("nbr", "buna-n"),
    "viton": ("fkm",),
    "assembly": ("assy", "asm"),
    "spare": ("sp", "spr part"),
}

#: Canonical unit and its spellings.
UNITS = {
    "mm": ("mm", "m.m.", "millimetre", "millimeter"),
    "cm": ("cm", "c.m.", "centimetre", "centimeter"),
    "m": ("mtr", "meter", "metre", "mts"),
    "inch": ('"', "in", "inches", "inch", "nb", "n.b.", "nominal bore"),
    "kg": ("kg", "k.g.", "kilogram", "kgs"),
    "nos": ("nos", "no", "no.", "nr", "pcs", "pieces", "each", "ea"),
    "sqmm": ("sqmm", "sq mm", "sq.mm", "mm2", "mm^2", "sq. mm"),
    "kw": ("kw", "k.w.", "kilowatt"),
    "kv": ("kv", "k.v.", "kilovolt"),
}

#: Material phrases and grades, in order of precedence.
MATERIALS = (
    ("stainless steel 316 graphite", "SS316GR"),
    ("stainless steel 304 graphite", "SS304GR"),
    ("compressed asbestos fibre", "CAF"),
    ("high tensile 8.8", "HT88"),
    ("stainless steel 316", "SS316"),
    ("stainless steel 304", "SS304"),
    ("galvanised iron", "GI"),
    ("carbon steel", "CS"),
    ("mild steel", "MS"),
    ("cast iron", "CI"),
    ("a106 gr b", "A106B"),
    ("wcb", "WCB"),
    ("nitrile", "NBR"),
    ("viton", "VITON"),
    ("epdm", "EPDM"),
    ("graphite", "GRAPHITE"),
)

#: Category phrases, in order of precedence.
CATEGORIES = (
    ("weld neck raised face flange", "wnrf_flange"),
    ("compressed asbestos fibre gasket", "caf_gasket"),
    ("spiral wound gasket", "spiral_gasket"),
    ("xlpe armoured cable", "xlpe_cable"),
    ("elbow 90 degree", "elbow_90"),
    ("induction motor", "induction_motor"),
    ("centrifugal pump", "centrifugal_pump"),
    ("seamless pipe", "seamless_pipe"),
    ("hexagonal bolt", "hex_bolt"),
    ("hexagonal nut", "hex_nut"),
    ("spring washer", "spring_washer"),
    ("plain washer", "plain_washer"),
    ("stud bolt", "stud_bolt"),
    ("ball bearing", "ball_bearing"),
    ("roller bearing", "roller_bearing"),
    ("gate valve", "gate_valve"),
    ("globe valve", "globe_valve"),
    ("ball valve", "ball_valve"),
    ("check valve", "check_valve"),
    ("o-ring", "o_ring"),
    ("flange", "wnrf_flange"),
    ("gasket", "spiral_gasket"),
    ("elbow", "elbow_90"),
    ("cable", "xlpe_cable"),
    ("motor", "induction_motor"),
    ("pump", "centrifugal_pump"),
    ("pipe", "seamless_pipe"),
    ("bearing", "ball_bearing"),
    ("valve", "gate_valve"),
    ("bolt", "hex_bolt"),
    ("nut", "hex_nut"),
    ("washer", "plain_washer"),
)

#: Specifications that identify an item, and the order in which they make block keys.
HARD_KEYS = ("thread", "length_mm", "bore_in", "pressure_class", "material_grade", "bearing_desig", "seal_type", "schedule", "cores", "csa_sqmm", "voltage_kv", "power_kw", "rpm", "id_mm", "section_mm", "cap_m3hr", "head_m", "dim_mm")
SIZE_KEYS = ("thread", "bore_in", "bearing_desig", "csa_sqmm", "power_kw", "cap_m3hr", "id_mm", "dim_mm", "length_mm")

#: Class code, segment, family, class, category, defining specifications.
CLASSES = (
    ("10.10.10", "Piping and Fluid Handling", "Pipes and Tubes", "Seamless Pipe", "seamless_pipe", ("bore_in", "schedule", "material_grade")),
    ("10.20.10", "Piping and Fluid Handling", "Pipe Fittings", "Elbow, 90 Degree", "elbow_90", ("bore_in", "schedule", "material_grade")),
    ("10.20.20", "Piping and Fluid Handling", "Pipe Fittings", "Flange, Weld Neck Raised Face", "wnrf_flange", ("bore_in", "pressure_class", "material_grade")),
    ("10.30.10", "Piping and Fluid Handling", "Valves", "Ball Valve", "ball_valve", ("bore_in", "pressure_class", "material_grade")),
    ("10.30.20", "Piping and Fluid Handling", "Valves", "Gate Valve", "gate_valve", ("bore_in", "pressure_class", "material_grade")),
    ("10.30.30", "Piping and Fluid Handling", "Valves", "Globe Valve", "globe_valve", ("bore_in", "pressure_class", "material_grade")),
    ("10.30.40", "Piping and Fluid Handling", "Valves", "Check Valve", "check_valve", ("bore_in", "pressure_class", "material_grade")),
    ("10.40.10", "Piping and Fluid Handling", "Static Sealing", "Gasket, Spiral Wound", "spiral_gasket", ("bore_in", "pressure_class", "material_grade")),
    ("10.40.20", "Piping and Fluid Handling", "Static Sealing", "Gasket, Compressed Fibre", "caf_gasket", ("bore_in", "dim_mm", "material_grade")),
    ("10.40.30", "Piping and Fluid Handling", "Static Sealing", "O-Ring", "o_ring", ("id_mm", "section_mm", "material_grade")),
    ("20.10.10", "Fasteners", "Bolts and Studs", "Bolt, Hexagonal", "hex_bolt", ("thread", "length_mm", "material_grade")),
    ("20.10.20", "Fasteners", "Bolts and Studs", "Bolt, Stud", "stud_bolt", ("thread", "length_mm", "material_grade")),
    ("20.20.10", "Fasteners", "Nuts", "Nut, Hexagonal", "hex_nut", ("thread", "material_grade")),
    ("20.30.10", "Fasteners", "Washers", "Washer, Plain", "plain_washer", ("thread", "material_grade")),
    ("20.30.20", "Fasteners", "Washers", "Washer, Spring", "spring_washer", ("thread", "material_grade")),
    ("30.10.10", "Rotating Equipment", "Pumps", "Pump, Centrifugal", "centrifugal_pump", ("cap_m3hr", "head_m", "material_grade")),
    ("30.20.10", "Rotating Equipment", "Bearings", "Bearing, Ball", "ball_bearing", ("bearing_desig", "seal_type")),
    ("30.20.20", "Rotating Equipment", "Bearings", "Bearing, Roller", "roller_bearing", ("bearing_desig",)),
    ("40.10.10", "Electrical", "Rotating Electrical Machines", "Motor, Induction", "induction_motor", ("power_kw", "rpm")),
    ("40.20.10", "Electrical", "Cables and Conductors", "Cable, XLPE Armoured", "xlpe_cable", ("cores", "csa_sqmm", "voltage_kv")),
)
UNCLASSIFIED = ("99.99.99", "Unclassified", "Pending Classification", "Unclassified", "", ())

#: Damm's totally anti-symmetric quasigroup of order 10.
DAMM = (
    (0, 3, 1, 7, 5, 9, 8, 6, 4, 2),
    (7, 0, 9, 2, 1, 5, 4, 8, 6, 3),
    (4, 2, 0, 6, 8, 7, 1, 3, 5, 9),
    (1, 7, 5, 0, 9, 8, 3, 4, 2, 6),
    (6, 1, 2, 3, 0, 4, 5, 9, 7, 8),
    (3, 6, 7, 4, 2, 0, 9, 5, 8, 1),
    (5, 8, 6, 9, 7, 2, 0, 1, 3, 4),
    (8, 9, 4, 5, 3, 6, 2, 0, 1, 7),
    (9, 4, 3, 8, 6, 1, 7, 2, 0, 5),
    (2, 5, 8, 1, 4, 3, 6, 7, 9, 0),
)

#: National code format.
CODE_PREFIX = "NMC"
SERIAL_DIGITS = 5

#: Bodies of standards, longest first, and canonical suffix words.
BODIES = ("BS EN", "IS/ISO", "IS/IEC", "ASTM", "ASME", "DIN", "ISO", "IEC", "JIS", "SAE", "AISI", "UNS", "API", "BS", "EN", "IS")
SUFFIXES = {"PT": "PART", "GR": "GRADE", "CL": "CLASS", "TY": "TYPE"}

#: Scoring weights and decision thresholds.
WEIGHT_COS, WEIGHT_FUZZY, WEIGHT_ATTR = 0.60, 0.25, 0.15
DISCARD_BELOW, AUTO_FROM, MIN_COVERAGE = 0.75, 0.92, 2
