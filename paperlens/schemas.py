"""Schemas of records that come from outside."""

from __future__ import annotations

PAPER = "id string, title string, authors array<string>, summary string, pdf_url string, published timestamp, source_type string, source_url string, external_id string"
ATOM_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>"
OAI_RECORD = "id string, created string, title string, abstract string, authors struct<author:array<struct<keyname:string,forenames:string>>>"
LINE = "struct<bbox:array<float>,spans:array<struct<type:string,content:string,image_path:string>>>"
SUB_BLOCK = f"struct<type:string,bbox:array<float>,image_path:string,lines:array<{LINE}>>"
PARA_BLOCK = f"struct<type:string,bbox:array<float>,blocks:array<{SUB_BLOCK}>,lines:array<{LINE}>>"
LAYOUT = f"pdf_info array<struct<page_idx:int,page_size:array<float>,para_blocks:array<{PARA_BLOCK}>,preproc_blocks:array<{PARA_BLOCK}>,discarded_blocks:array<{PARA_BLOCK}>>>"
RAW_BLOCK = "paper_id string, page_idx int, pos int, block_type string, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string"
