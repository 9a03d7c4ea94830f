"""Fixed values of the data model."""

# Ribosome binding site motif groups (compared in upper case).
CANONICAL_SD_MOTIFS = [
    "3Base/5BMM", "4Base/6BMM", "AGG", "AGGA", "AGGA/GGAG/GAGG",
    "AGGAG", "AGGAG/GGAGG", "AGGAG(G)/GGAGG", "AGGAGG",
    "AGxAG", "AGxAGG/AGGxGG", "GAG", "GAGG", "GAGGA",
    "GGA", "GGA/GAG/AGG", "GGAG", "GGAG/GAGG", "GGAGG", "GGAGGA", "GGxGG",
]
BACTEROIDETES_MOTIFS = ["TAA", "TAAA", "TAAAA", "TAAAT", "TAAAAA", "TAAAAT"]
TATATA_MOTIFS = ["ATA", "ATAT", "ATATA", "ATATAT", "TAT", "TATA", "TATAT", "TATATA"]

# Gene-architecture feature names, in model order.
ARCH_FEATURES = [
    "fragment_size", "strand_switch_rate", "coding_density",
    "leaderless_freq", "short_utr_freq", "no_rbs_freq",
    "sd_bacteroidetes_rbs_freq", "sd_canonical_rbs_freq", "tatata_rbs_freq",
    "mean_rbs_score", "gene_density", "gene_density_fwd", "gene_density_rev",
]
ARCH_MODEL_FEATURES = [name for name in ARCH_FEATURES if name != "fragment_size"]

# Marker feature names, in model order.
DOMAIN_MARKER_FEATURES = [
    "prok_marker_freq", "euk_marker_freq",
    "prok_median_bitscore", "euk_median_bitscore",
    "prok_max_bitscore", "euk_max_bitscore",
]
HOST_MARKER_FEATURES = [
    "protist_marker_freq", "fungi_marker_freq", "animal_marker_freq", "plant_marker_freq",
    "protist_median_bitscore", "fungi_median_bitscore",
    "animal_median_bitscore", "plant_median_bitscore",
    "protist_max_bitscore", "fungi_max_bitscore",
    "animal_max_bitscore", "plant_max_bitscore",
]

# Marker class codes behind each marker feature family.
DOMAIN_FAMILIES = {"prok": ["K"], "euk": ["A", "F", "P", "T", "E"]}
HOST_FAMILIES = {"protist": ["T", "KT"], "fungi": ["F"], "animal": ["A"], "plant": ["P"]}
GATE_CODES = ["A", "F", "P", "T", "K", "KT"]

# Feature groups that can be masked.
DENSITY_GROUP = ["gene_density", "gene_density_fwd", "gene_density_rev", "strand_switch_rate"]
BOUNDARY_GROUP = ["leaderless_freq", "short_utr_freq"]

# Columns of an alignment hit, and the column order of the annotation report.
HIT_COLUMNS = [
    "query", "target", "evalue", "bits", "qlen", "tlen",
    "qstart", "qend", "tstart", "tend", "alnlen",
]
ANNOTATION_COLUMNS = [
    "parent_seq_id", "protein_id", "amino_acid_sequence",
    "protein_start", "protein_end", "protein_strand",
    "partial_begin", "partial_end", "start_type",
    "rbs_motif", "rbs_spacer", "translation_table",
    "marker_id", "evalue", "bitscore",
    "query_length", "target_length", "query_start", "query_end",
    "target_start", "target_end", "alignment_length",
    "query_coverage", "target_coverage",
]

# The name of a chunk without a class, and the columns of the genome and chunk reports.
UNASSIGNED = "Unassigned"
GENOME_COLUMNS = ["genome", "predicted_domain", "domain_confidence", "predicted_host", "confidence"]
CHUNK_DOMAIN_COLUMNS = ["prokaryote_score", "eukaryote_score", "predicted_domain", "domain_confidence"]

# Class labels that are shown under another name.
LABEL_RENAMES = {"Metazoa (All Animals)": "Animal", "Viridiplantae (Plants)": "Plant"}

# The standard genetic code, codons in TCAG order, and the start codons scanned.
CODON_BASES = "TCAG"
CODON_AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
START_CODONS = ["ATG", "GTG", "TTG"]
TRANSLATION_TABLE = 11

# Amino acids and how often they occur in proteins.
RESIDUE_FREQUENCIES = {
    "A": 0.078, "R": 0.051, "N": 0.045, "D": 0.054, "C": 0.019, "Q": 0.043, "E": 0.063, "G": 0.074, "H": 0.022, "I": 0.051,
    "L": 0.091, "K": 0.057, "M": 0.022, "F": 0.039, "P": 0.052, "S": 0.071, "T": 0.058, "W": 0.013, "Y": 0.032, "V": 0.064,
}

# Binding sites before a start codon, strongest first: motif bin, pattern, bases between it and the start.
BINDING_SITES = [
    ("AGGAGG", "AGGAGG", 5, 10), ("AGGAGG", "AGGAGG", 3, 4), ("AGGAGG", "AGGAGG", 11, 12),
    ("GGAGG", "GGAGG", 5, 10), ("AGGAG", "AGGAG", 5, 10),
    ("AGGAG/GGAGG", "(AGGAG|GGAGG)", 11, 12), ("AGGAG/GGAGG", "(AGGAG|GGAGG)", 3, 4),
    ("AGxAGG/AGGxGG", "(AG.AGG|AGG.GG)", 5, 10), ("AGxAGG/AGGxGG", "(AG.AGG|AGG.GG)", 3, 4),
    ("AGxAGG/AGGxGG", "(AG.AGG|AGG.GG)", 11, 12),
    ("GGAG/GAGG", "(GGAG|GAGG)", 5, 10), ("AGGA", "AGGA", 5, 10), ("GGxGG", "GG.GG", 5, 10),
    ("AGGA/GGAG/GAGG", "(AGGA|GGAG|GAGG)", 11, 12), ("AGGA/GGAG/GAGG", "(AGGA|GGAG|GAGG)", 3, 4),
    ("AGGAG(G)/GGAGG", "(AGGAGG?|GGAGG)", 13, 15), ("AGxAG", "AG.AG", 5, 10),
    ("GGxGG", "GG.GG", 3, 4), ("GGxGG", "GG.GG", 11, 12),
    ("TATATA", "TATATA", 5, 10), ("TAAAAA", "TAAAAA", 5, 10), ("TAAAAT", "TAAAAT", 5, 10),
    ("TATAT", "TATAT", 5, 10), ("ATATA", "ATATA", 5, 10), ("TAAAA", "TAAAA", 5, 10), ("TAAAT", "TAAAT", 5, 10),
    ("GGA/GAG/AGG", "(GGA|GAG|AGG)", 5, 10), ("GGA/GAG/AGG", "(GGA|GAG|AGG)", 11, 12),
    ("AGxAG", "AG.AG", 3, 4), ("AGxAG", "AG.AG", 11, 12),
    ("4Base/6BMM", "(AGGA|GGAG|GAGG)", 13, 15), ("3Base/5BMM", "(GGA|GAG|AGG)", 13, 15),
    ("GGA/GAG/AGG", "(GGA|GAG|AGG)", 3, 4),
]
