"""The tables of the engine as DDL strings."""

REGION = "struct<page_number:int,polygon:array<double>>"
CELL = "struct<row_index:int,column_index:int,text:string,row_span:int,column_span:int>"
PARAGRAPH = f"struct<seq:int,text:string,role:string,page_number:int,source_anchor:string,source_start:int,source_end:int,bounding_regions:array<{REGION}>>"
TABLE = f"struct<seq:int,page_number:int,row_count:int,column_count:int,cells:array<{CELL}>,source_anchor:string,source_start:int,source_end:int,bounding_regions:array<{REGION}>>"
PAGE = "struct<page_number:int,width:double,height:double,unit:string>"
RAW = f"model_id string, api_version string, pages array<{PAGE}>, paragraphs array<{PARAGRAPH}>, tables array<{TABLE}>"
ELEMENT = f"struct<pos:int,element_id:string,type:string,page_number:int,section_path:array<string>,text:string,source_anchor:string,source_start:int,source_end:int,row_count:int,column_count:int,cells:array<{CELL}>,bounding_regions:array<{REGION}>>"
SECTION = "struct<section_id:string,parent_section_id:string,sibling_index:int,heading:string,level:int,page_number:int,path:array<string>,content:array<string>,source_anchor:string,source_start:int,source_end:int>"
#: What a heading's numbering says against it: another number than due, or depths that compete.
WARNING = "struct<kind:string,heading:string,page_number:int,expected:string,found:string>"
STRUCTURE = f"sections array<{SECTION}>, elements array<{ELEMENT}>, warnings array<{WARNING}>"
CHUNK = "struct<chunk_id:string,document_id:string,document_title:string,section_path:array<string>,page_start:int,page_end:int,source_anchor:string,source_start:int,source_end:int,element_ids:array<string>,chunk_type:string,text:string,embed_text:string>"
REGISTRY = "sha256 string, local_filename string, display_name string, case_name string, title string, docket_number string, court string, jurisdiction string, year int, legal_topic string, source_url string, source_kind string, company_name string, form_type string, accession_number string, filing_date string, exhibit_identity string"
GOLD = "question_id string, question string, expected_document_ids array<string>"
QUESTION_RESULT = "question_id string, retrieval_hit boolean, citation_count int, citation_provenance_valid boolean, failure_reason string"
RUN_ENTRY = f"document_id string, run_id string, correlation_id string, source_file string, processing_duration_seconds double, page_count int, output_path string, warnings array<{WARNING}>, extraction_status string, error string"
