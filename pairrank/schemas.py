"""Row schemas of the keyed tables and the run log."""

from __future__ import annotations

# Names and types of the stored columns.
PROTEINS = "id string, source string, external_id string, sequence string, metadata map<string,string>"

COMPOUNDS = "id string, source string, external_id string, smiles string, metadata map<string,string>"

INTERACTIONS = (
    "id string, compound_id string, protein_id string, interaction_type string, label int, "
    "affinity_value double, affinity_unit string, assay_type string, confidence double, "
    "source string, external_id string, ingested_at timestamp"
)

RUNS = (
    "run_id string, status string, source string, stats string, checksums map<string,string>, "
    "error string, rows_in long, rows_upserted long, rows_rejected long, entity_type string, "
    "format string, batch_id long, stages map<string,double>, started_at timestamp, ended_at timestamp"
)

TABLES = {"compound": COMPOUNDS, "protein": PROTEINS, "interaction": INTERACTIONS}

# Columns an upsert replaces when (source, external_id) is already there; the id is kept.
PAYLOAD = {
    "compound": ["smiles", "metadata"],
    "protein": ["sequence", "metadata"],
    "interaction": [
        "compound_id", "protein_id", "interaction_type", "label", "affinity_value",
        "affinity_unit", "assay_type", "confidence", "ingested_at",
    ],
}
