"""Schemas of the engine's tables, and values that are part of their meaning."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t) if "<" in t else _SIMPLE[t]) for n, t in (x.split(":") for x in spec.split(" "))])


_SIMPLE = {"s": T.StringType(), "b": T.BooleanType(), "i": T.IntegerType(), "l": T.LongType(), "d": T.DoubleType(), "t": T.TimestampType()}

TRIPLES = _struct("g:s s:s p:s o:s o_kind:s o_lang:s o_dtype:s")
ISA = _struct("child:s parent:s")
RESTRICTIONS = _struct("subject:s role:s filler:s")
CDES = _struct("public_id:s version:s short_name:s long_name:s definition:s context:s workflow_status:s registration_status:s datatype:s value_domain_type:s search_text:s cde_json:s")
CDE_CONCEPTS = _struct("concept_code:s concept_name:s public_id:s version:s concept_type:s is_primary:i hierarchy_depth:i is_leaf:i")
CONSTITUENTS = _struct("run_id:s concept_code:s axis:s filler_code:s axis_source:s most_specific:b needs_review:b relationship_group:s")
MAPPINGS = _struct("run_id:s subject_id:s predicate_id:s object_id:s mapping_justification:s confidence:d subject_source_version:s object_source_version:s lifecycle_state:s review_status:s author:s")

# They must equal the terminology's for right results.
IN_SCOPE_TYPES = ("Neoplastic Process", "Disease or Syndrome", "Cell or Molecular Dysfunction")
LINEAGE_GENERA = ("C3010", "C3809", "C3773")
ORGAN_TYPE = "Body Part, Organ, or Organ Component"
DROPPED_ROLES = ("R114", "R115")
STAGE_SYSTEMS = ("C132248", "C180901", "C186617", "C186618", "C198024", "C90529", "C90530")
CORE_ROLES = ("R88", "R101", "R100", "R102", "R105", "R106", "R135")
STAGING_MARKERS = ("stage i", "stage ii", "stage iii", "stage iv", "ajcc", " v7", " v8", "unresectable", "recurrent", "metastatic", " by ")
ASPECT_MARKERS = (" with ", " without ", " of the ", "stage", "grade")
INGEST_ROLES = ("R101", "R100", "R102", "R105")
CONFIDENCE = {"xref": 0.9, "lexical": 0.5, "composite": 0.95}
EQUIVALENCE = {"skos:exactMatch": "equivalent", "skos:closeMatch": "close", "skos:broadMatch": "broad", "skos:narrowMatch": "narrow"}
PREDICATES = ("skos:exactMatch", "skos:closeMatch", "skos:broadMatch", "skos:narrowMatch", "skos:relatedMatch")
LIFECYCLE = ("proposed", "validated", "active", "quarantined", "retired")
EVIDENCE_KINDS = ("label_agreement", "xref_assertion", "structural_corroboration", "sme_curation")
LICENSED_PREFIXES = ("SNOMED", "ICD-O-3")
EXPANDABLE_PREFIXES = ("UBERON", "CL")
EDGE_LIMIT, NODE_CAP = 200, 400
