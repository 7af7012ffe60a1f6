"""Vocabularies, patterns and bin edges of the token dialects."""

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

# Spellings each null policy treats as wild type or as missing.
V47_WILD_TYPE = ["", "WT", "NAN", "NONE", "<NA>"]
JH_NON_MUTATION = ["", "WT", "MISSING"]
JYP_MISSING = ["", ".", "-", "NA", "N/A", "NAN", "NONE", "NULL", "MISSING"]
JSJ_WILD_TYPE = ["", "WT", "NAN", "NONE"]

# Consequence classes per dialect, in their reporting order.
JH_CLASSES = ["MISSENSE", "SYNONYMOUS", "STOP", "FRAMESHIFT", "COMPLEX", "OTHER", "UNPARSED"]
EM5_NAMES = ["synonymous", "missense", "inframe", "nonsense", "frameshift"]
EM4_NAMES = ["synonymous", "missense", "inframe_complex", "truncating"]
JSJ1_TYPES = ["SUB", "STOP", "FS", "DEL", "INS", "DELINS", "DUP", "OTHER"]
JSJ2_TYPES = ["SUB", "SYN", "STOP", "FS", "DEL", "INS", "DELINS", "OTHER"]
JSJ3_KINDS = ["FS", "STOP", "MISSENSE", "SILENT"]
F_KINDS = ["missense", "nonsense", "frameshift", "splice"]

# Upper bin edges and bin names of protein positions.
POSITION_BINS = {
    "jyp": ([50, 100, 250, 500, 1000],
            ["pos_1_50", "pos_51_100", "pos_101_250", "pos_251_500", "pos_501_1000", "pos_gt_1000"]),
    "jh": ([50, 100, 200, 400, 800], ["1-50", "51-100", "101-200", "201-400", "401-800", "801+"]),
    "jsj": ([50, 100, 250, 500], ["001_050", "051_100", "101_250", "251_500", "501_PLUS"]),
}

# Burden bins.
BURDEN_BINS = ([5, 9, 16, 33], ["0-5", "6-9", "10-16", "17-33", "34+"])

# The short and the long marker gene list.
MARKER_GENES = ["IDH1", "APC", "PTEN", "BRAF", "TP53", "PLEC", "VHL", "PCLO", "PIK3CA", "MXRA5"]
MARKER_GENES_LONG = [
    "APC", "ATRX", "BRAF", "BTG1", "BTG2", "CDKN1A", "CDKN2A", "CMPK2", "CTNNB1", "DST", "EGFR", "HRAS", "IDH1", "IDH2", "KIT",
    "KMT2D", "MXRA5", "NCOR2", "NLRP3", "NOTCH1", "NPM1", "PCLO", "PIK3CA", "PIM1", "PKD1", "PLEC", "PLXNB2", "PTEN", "RYR2",
    "SOWAHC", "SPOP", "SPTA1", "SYNE1", "TP53", "VHL"
]

# Canonical pathway gene sets (Sanchez-Vega et al., Cell 2018).
PATHWAYS = {
    "cell_cycle": ["CDKN2A", "CDKN2B", "CCND1", "CCND2", "CCND3", "CDK4", "CDK6", "RB1", "RBL1", "RBL2", "E2F1", "E2F2", "E2F3", "E2F4", "E2F5"],
    "hippo": [
        "NF2", "LATS1", "LATS2", "STK3", "STK4", "SAV1", "YAP1", "WWTR1", "FAT1", "FAT2", "FAT3", "FAT4", "TEAD1", "TEAD2", "TEAD3",
        "TEAD4"
    ],
    "myc": ["MYC", "MYCN", "MYCL", "MAX", "MGA", "MNT", "MXD1", "FBXW7"],
    "notch": ["NOTCH1", "NOTCH2", "NOTCH3", "NOTCH4", "FBXW7", "EP300", "CREBBP", "NCOR1", "NCOR2", "SPEN", "MAML1", "MAML2", "MAML3"],
    "nrf2": ["NFE2L2", "KEAP1", "CUL3"],
    "pi3k_akt": [
        "PIK3CA", "PIK3CB", "PIK3R1", "PIK3R2", "PTEN", "AKT1", "AKT2", "AKT3", "MTOR", "TSC1", "TSC2", "STK11", "RHEB", "RICTOR",
        "INPP4B"
    ],
    "rtk_ras": [
        "EGFR", "ERBB2", "ERBB3", "ERBB4", "KRAS", "NRAS", "HRAS", "BRAF", "RAF1", "MAP2K1", "MAP2K2", "MAPK1", "MAPK3", "NF1", "RASA1",
        "ALK", "ROS1", "RET", "MET", "FGFR1", "FGFR2", "FGFR3", "FGFR4", "KIT", "PDGFRA", "PDGFRB"
    ],
    "tgf_beta": ["TGFBR1", "TGFBR2", "SMAD2", "SMAD3", "SMAD4", "ACVR1B", "ACVR2A", "BMPR2"],
    "p53": ["TP53", "MDM2", "MDM4", "ATM", "CHEK1", "CHEK2", "CDKN2A"],
    "wnt": ["APC", "CTNNB1", "AXIN1", "AXIN2", "RNF43", "ZNRF3", "TCF7L2", "AMER1"],
}

# Study families of the class labels.
FAMILIES = {
    "urothelial": ["BLCA"],
    "breast": ["BRCA"],
    "female_reproductive": ["CESC", "OV", "UCEC"],
    "digestive": ["COAD", "LIHC", "PAAD", "STES"],
    "hematolymphoid": ["DLBC", "LAML"],
    "central_nervous_system": ["GBMLGG", "LGG"],
    "head_and_neck": ["HNSC"],
    "kidney": ["KIPAN", "KIRC"],
    "thoracic": ["LUAD", "LUSC", "THYM"],
    "endocrine_neuroendocrine": ["ACC", "PCPG", "THCA"],
    "male_reproductive": ["PRAD", "TGCT"],
    "mesenchymal": ["SARC"],
    "skin": ["SKCM"],
}

# Families whose members are contrasted with each other.
SIBLING_FAMILIES = [
    "central_nervous_system", "kidney", "thoracic", "female_reproductive", "digestive",
    "endocrine_neuroendocrine", "male_reproductive",
]

# Label pairs whose signatures are subtracted.
CONTRAST_PAIRS = [("KIRC", "KIPAN"), ("LGG", "GBMLGG")]
