"""Result schemas, as DDL."""

SEGMENT = "struct<id:string,text:string,start_time:double,end_time:double,metadata:map<string,string>>"
WARNING = "struct<code:string,message:string>"
ERROR = "struct<code:string,message:string,file_name:string,actual_bytes:bigint,max_bytes:bigint,reason:string,format:string>"
DOCUMENT = f"struct<title:string,source_url:string,format:string,text:string,raw_text:string,segments:array<{SEGMENT}>,metadata:map<string,string>,warnings:array<{WARNING}>>"
BLOCK = "struct<id:string,kind:string,level:int,text:string>"
ARTICLE = f"struct<title:string,source_url:string,blocks:array<{BLOCK}>,metadata:map<string,string>,text:string>"
