"""The long-form data model: explicit schemas of every table (DDL).

Missing values are NULL, never NaN; sums are long; rates are double."""

POSITION = (
    "gene string, pos long, `end` long, gene_position string, mutrate double, strand string, coverage long, "
    "adj_coverage long, mutant long, normalized_cov double, g_readcount long, refnt string, detail string"
)
WINDOW = "gene string, win long, coverage long, mutant long, mutrate double, win_end long"
CELL_POSITION = "gene string, pos long, ref string, cell string, cell_idx int, dp int, ad int, oth int, all_counts array<int>"
CELL_WINDOW = "gene string, win long, win_end long, ref string, cell string, dp long, ad long, mr double"
ALIGNMENT_COLUMNS = {
    "ord": "long", "read_id": "string", "flag": "int", "ref_name": "string", "ref_start": "long", "ref_length": "int", "mapq": "int",
    "cigar": "array<struct<op:int,len:int>>", "seq": "string", "qual": "string", "tags": "map<string,string>",
    "tag_types": "map<string,string>", "mate_ref_name": "string", "mate_start": "long", "template_length": "int",
}
ALIGNMENTS = ", ".join(f"{name} {kind}" for name, kind in ALIGNMENT_COLUMNS.items())
FASTQ = "file string, rec long, header string, sequence string, plus string, quality string"
BASE_VCF = "gene string, pos long, ref string, coverage long, mutrate double"
GENE_COUNTS = "gene string, length long, reads long, total_reads long"
SWEEP = (
    "directory string, stem string, sensitivity string, mp string, rdg string, rfg string, total_reads long, aligned_exactly_1 long, "
    "aligned_multiple long, unaligned long, overall_rate double, exact_rate double, multiple_rate double, calculated_rate double"
)
