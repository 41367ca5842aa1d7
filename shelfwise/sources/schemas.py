"""Declared shapes of landed payloads and of the library's own rows."""

from __future__ import annotations

from ..functions.deals import DEAL

UNIFIED = f"""chain string, store_id string, store_name string, product_id string, name string,
price decimal(18,2), regular_price decimal(18,2), sale_price decimal(18,2), discount_percent double,
barcode string, image_url string, category_ids array<string>, is_weighable boolean, unit_description string,
unit_of_measure string, unit_qty double, unit_qty_si double, unit_dimension string, price_per_base_unit double,
deal {DEAL}, brand string, manufacturer string, scraped_at timestamp"""

STOREFRONT = """total bigint, products array<struct<id:bigint, productId:bigint, localName:string, barcode:string,
names:struct<`1`:struct<long:string, short:string>>, image:struct<url:string>, isWeighable:boolean, weight:double,
unitOfMeasure:struct<names:struct<`1`:string>>, brand:struct<names:struct<`1`:string>>,
family:struct<categories:array<struct<id:bigint>>>,
branch:struct<id:bigint, isActive:boolean, isVisible:boolean, isOutOfStock:boolean, regularPrice:double, salePrice:double,
specials:array<struct<description:string, names:struct<`1`:struct<name:string>>,
firstLevel:struct<type:int, firstPurchaseTotal:double, firstGift:struct<total:double>>>>>>>"""

SEARCH = """pagination struct<pageSize:int, numberOfPages:int, totalNumberOfResults:bigint>,
results array<struct<sku:string, code:string, name:string, ean:string, price:struct<value:double>, categoryPrice:struct<value:double>,
promotionMsg:string, promotionCodes:array<string>, allCategoryCodes:array<string>,
images:array<struct<imageType:string, format:string, url:string>>, sellingMethod:struct<code:string>, brand:struct<name:string>,
manufacturer:string, unitDescription:string, unitForComparison:string, valueForComparison:double>>"""

GRAPHQL = """data struct<products:struct<total_count:bigint, page_info:struct<page_size:int, current_page:int, total_pages:int>,
items:array<struct<id:string, sku:string, name:string, brand:string, by_kilo:int, item_unit:string, small_image:struct<url:string>,
categories:array<struct<id:string>>,
price_range:struct<minimum_price:struct<regular_price:struct<value:double>, final_price:struct<value:double>, discount:struct<percent_off:double>>>,
price_tiers:array<struct<quantity:double, final_price:struct<value:double>>>>>>>, errors array<struct<message:string>>"""

CATALOG = """total bigint, data array<struct<id:bigint, name:string, barcode:bigint, price:struct<price:double>, prop:struct<by_kilo:int>,
gs:struct<BrandName:string, Manufacturer_Name:string, Net_Content:struct<UOM:string, value:string>>,
sale:array<struct<scm:double, name:string, label:string>>, images:struct<small:string>, department:struct<id:bigint>,
`group`:struct<id:bigint>, subGroup:struct<id:bigint>, department_id:bigint, group_id:bigint, sub_group_id:bigint>>"""

AUTOCOMPLETE = "id string, value string, label string, parts struct<name_and_contents:string, manufacturer_and_barcode:string, pack_size:string, chainnames:string>"

_LEAF = "id:string, name:string, is_category:boolean, status:int"
_LEVELS = f"array<struct<{_LEAF}>>"
for _ in range(2):  # four levels in all
    _LEVELS = f"array<struct<{_LEAF}, children:{_LEVELS}>>"
CATEGORY_TREE = f"id string, name string, is_category boolean, status int, children {_LEVELS}"
BRANCHES = "id string, store_id string, store_code string, name string, city string, address string, lat double, lng double, internet_id string"
