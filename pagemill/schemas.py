"""Schemas of the engine's tables."""

FORM_FIELD = "struct<field_type:string,name:string,label:string,placeholder:string,required:boolean,options:array<string>>"
BLOCK = (
    "struct<type:string,level:int,text:string,original_url:string,local_path:string,alt_text:string,items:array<string>,action:string,method:string,"
    f"fields:array<{FORM_FIELD}>,submit_text:string,purpose:string,provider:string,src:string,title:string,caption:string,headers:array<string>,rows:array<array<string>>,"
    "language:string,cite:string,kind:string,poster:string,definitions:array<struct<term:string,description:string>>>"
)
#: Fields of a captured page that the extractor can give, with their types.
PAGE_FIELDS = {
    "title": "string", "meta_title": "string", "meta_description": "string", "og_image_url": "string", "twitter_card": "string", "meta_robots": "string", "canonical_url": "string", "language": "string", "favicon_url": "string", "logo_url": "string",
    "hreflang_alternates": "array<struct<lang:string,url:string>>", "nav_links": "array<struct<text:string,href:string,description:string,role:string>>", "footer_blocks": f"array<{BLOCK}>", "structured_data": "array<string>", "content_blocks": f"array<{BLOCK}>",
    "internal_links_out": "array<string>", "crawl_links": "array<string>", "stylesheet_urls": "array<string>", "style_text": "string", "body_text": "string", "chrome_text": "string", "contact_links": "array<string>",
    "social_links": "array<struct<platform:string,url:string>>", "addresses": "array<string>", "organization": "string",
}
EDGES = "site string, src_url string, dst_url string, link_pos int"
