"""Seeds and rules that results depend on, as plain tables, one row a line, columns parted by "|".

Order matters wherever the first match wins.
"""

# Name | aliases | category | parent company | pattern (patterns hold their own bars, so they come last).
BRANDS = r"""
Circle K|CircleK;circlek;circle-k|retail|Alimentation Couche-Tard|\bcircle\s*[-]?k\b
GS25|GS 25;gs25|retail|GS Retail|\bgs\s*25\b
FamilyMart|Family Mart;familymart|retail|FamilyMart|\bfamily\s*mart\b
7-Eleven|7 Eleven;7eleven;seven eleven|retail|Seven & i|\b7[-\s]?eleven\b|\bseven\s*eleven\b
Ministop|Mini Stop;mini-stop|retail|AEON|\bmini[-\s]?stop\b
WinMart+|Winmart+;Vinmart+;WinMart Plus;VinMart Plus|retail|Masan Group|\b(win|vin)mart\s*\+?\b
Satrafoods|Satra Foods;satra|retail|SATRA|\bsatra\s*foods?\b
Co.op Food|Coop Food;Co-op Food|retail|Saigon Co.op|\bco[\.\-\s]?op\s*food\b
Bach Hoa Xanh|Bách Hóa Xanh;BHX;bachhoaxanh|retail|Mobile World|\bb[aá]ch\s*h[oó]a\s*xanh\b|\bbhx\b
Co.opmart|Coopmart;Co-op Mart;Saigon Co.op|retail|Saigon Co.op|\bco[\.\-\s]?op\s*mart\b
Big C|BigC;GO!;Big C / GO!|retail|Central Retail|\bbig\s*c\b|\bgo\s*!\s*
Lotte Mart|LotteMart;Lotte-Mart|retail|Lotte Group|\blotte\s*mart\b
AEON|Aeon Mall;AeonMall;Aeon Vietnam|retail|AEON|\baeon\b
MM Mega Market|MM Market;Mega Market;Metro Cash & Carry|retail|TCC Group|\bmm\s*mega\s*market\b|\bmega\s*market\b
WinMart|Winmart;Vinmart;VinMart|retail|Masan Group|\b(win|vin)mart\b(?!\s*\+)
Emart|E-mart;E Mart|retail|THACO|\be[-\s]?mart\b
Tops Market|Tops|retail|Central Retail|\btops\s*market\b
Vincom|Vincom Center;Vincom Plaza;Vincom Mega Mall|retail|Vingroup|\bvincom\b
Crescent Mall|Crescent|retail|Crescent Mall|\bcrescent\s*mall\b
Lotte Mall|Lotte Mall West Lake;Lotte Mall Hanoi|retail|Lotte Group|\blotte\s*mall\b
Highlands Coffee|Highlands;HLC|hospitality|Jollibee Foods|\bhighlands\s*coffee\b|\bhighlands\b(?!\s*park)
Starbucks|Starbucks Coffee|hospitality|Starbucks|\bstarbucks\b
The Coffee House|Coffee House;TCH|hospitality|Seedcom|\bthe\s*coffee\s*house\b|\bcoffee\s*house\b
Trung Nguyen Legend|Trung Nguyên;Trung Nguyen;TN Legend|hospitality|Trung Nguyen|\btrung\s*nguy[eê]n\b
Phuc Long|Phúc Long|hospitality|Masan Group|\bph[uú]c\s*long\b
Cong Caphe|Cộng Cà Phê;Cong Ca Phe|hospitality|Cong Caphe|\bc[oộ]ng\s*c[àa]\s*ph[êe]\b
Katinat|Katinat Saigon Kafe|hospitality|D1 Concepts|\bkatinat\b
Phe La|Phê La|hospitality|Phe La|\bph[êe]\s*la\b
KFC|Kentucky Fried Chicken|hospitality|Yum! Brands|\bkfc\b|\bkentucky\s*fried\s*chicken\b
McDonald's|McDonalds;Mc Donald's;McD|hospitality|McDonald's|\bmc\s*donald'?s?\b
Lotteria|Lotte Eatz|hospitality|Lotte Group|\blotteria\b
Jollibee||hospitality|Jollibee Foods|\bjollibee\b
Pizza Hut||hospitality|Yum! Brands|\bpizza\s*hut\b
Domino's Pizza|Dominos;Domino Pizza|hospitality|Domino's|\bdomino'?s\b
The Pizza Company|Pizza Company|hospitality|Minor Food|\bthe\s*pizza\s*company\b|\bpizza\s*company\b
Burger King||hospitality|Restaurant Brands Intl.|\bburger\s*king\b
Texas Chicken|Church's Texas Chicken|hospitality|Inspire Brands|\btexas\s*chicken\b
Pho 24|Phở 24|hospitality|Jollibee Foods|\bph[ởo]\s*24\b
Thegioididong|Thế Giới Di Động;The Gioi Di Dong;TGDĐ|retail|Mobile World|\bth[eế]\s*gi[oớ]i\s*di\s*đ[oộ]ng\b|\btgd[đd]\b|\bthegioididong\b
FPT Shop|FPTShop|retail|FPT Retail|\bfpt\s*shop\b
Dien May Xanh|Điện Máy Xanh;DMX|retail|Mobile World|\bđi[eệ]n\s*m[aá]y\s*xanh\b|\bdmx\b
Nguyen Kim|Nguyễn Kim|retail|Central Retail|\bnguy[eễ]n\s*kim\b
CellphoneS|Cellphone S;cellphones|retail|CellphoneS|\bcellphones\b
Phong Vu|Phong Vũ|retail|Phong Vu|\bphong\s*v[uũ]\b
Pharmacity||retail|Pharmacity|\bpharmacity\b
Long Chau|Long Châu;Nhà thuốc Long Châu|retail|FPT Retail|\blong\s*ch[aâ]u\b
An Khang|Nhà thuốc An Khang|retail|Mobile World|\ban\s*khang\b
Guardian||health_and_beauty|DFI Retail Group|\bguardian\b
Watsons||health_and_beauty|A.S. Watson|\bwatsons\b
Medicare||health_and_beauty|Medicare|\bmedicare\b
Hasaki|Hasaki Beauty|health_and_beauty|Hasaki|\bhasaki\b
Sociolla||health_and_beauty|Social Bella|\bsociolla\b
Vietcombank|VCB;Ngân hàng TMCP Ngoại thương Việt Nam|financial|Vietcombank|\bvietcombank\b|\bvcb\b
VietinBank|CTG;Vietin Bank|financial|VietinBank|\bvietin\s*bank\b|\bvietinbank\b
BIDV|Ngân hàng Đầu tư và Phát triển Việt Nam|financial|BIDV|\bbidv\b
Agribank|Ngân hàng Nông nghiệp|financial|Agribank|\bagribank\b
Techcombank|TCB;Techcom Bank|financial|Techcombank|\btechcom\s*bank\b|\btechcombank\b
Sacombank|STB|financial|Sacombank|\bsacombank\b
ACB|Asia Commercial Bank|financial|ACB|\bacb\b
MB Bank|MBBank;Military Bank|financial|MB Bank|\bmb\s*bank\b|\bmbbank\b
VPBank|VP Bank|financial|VPBank|\bvp\s*bank\b|\bvpbank\b
HDBank|HD Bank|financial|HDBank|\bhd\s*bank\b|\bhdbank\b
TPBank|Tien Phong Bank;TP Bank|financial|TPBank|\btp\s*bank\b|\btpbank\b
SHB|Saigon-Hanoi Bank|financial|SHB|\bshb\b
Petrolimex|PLX|retail|Petrolimex|\bpetrolimex\b
PVOil|PV Oil;PetroVietnam Oil|retail|PetroVietnam|\bpv\s*oil\b|\bpvoil\b
Saigon Petro|SaigonPetro|retail|Saigon Petro|\bsaigon\s*petro\b
Shell||retail|Shell|\bshell\b
Caltex|Chevron|retail|Chevron|\bcaltex\b
CGV|CGV Cinemas|entertainment|CJ CGV|\bcgv\b
Lotte Cinema||entertainment|Lotte Group|\blotte\s*cinema\b
Galaxy Cinema|Galaxy|entertainment|Galaxy Studio|\bgalaxy\s*cinema\b
BHD Star|BHD;BHD Star Cineplex|entertainment|BHD|\bbhd\s*star\b
Viettel Post|ViettelPost;VTP|retail|Viettel Group|\bviettel\s*post\b
Vietnam Post|VN Post;VNPost|retail|Vietnam Post|\bvietnam\s*post\b|\bvnpost\b
Giao Hang Nhanh|GHN;Giao Hàng Nhanh|retail|GHN Express|\bghn\b|\bgiao\s*h[aà]ng\s*nhanh\b
Giao Hang Tiet Kiem|GHTK;Giao Hàng Tiết Kiệm|retail|GHTK|\bghtk\b|\bgiao\s*h[aà]ng\s*ti[eế]t\s*ki[eệ]m\b
J&T Express|JT Express|retail|J&T Express|\bj\s*&?\s*t\s*express\b
"""

# Category code | name | parent code | level.
TAXONOMY = r"""
transit|Transit||1
retail|Retail||1
outdoor|Outdoor||1
roadside|Roadside||1
education|Education||1
health_and_beauty|Health & Beauty||1
point_of_care|Point of Care||1
entertainment|Entertainment||1
leisure|Leisure||1
government|Government||1
office_buildings|Office Buildings||1
residential|Residential||1
financial|Financial||1
travel|Travel||1
sports_and_fitness|Sports & Fitness||1
hospitality|Hospitality||1
industrial|Industrial||1
farm|Farm||1
transit.airports|Airports|transit|2
transit.bus_stations|Bus Stations|transit|2
transit.rail|Rail Stations|transit|2
transit.subway|Subway / Metro|transit|2
transit.taxi_ride_share|Taxi / Ride Share|transit|2
transit.ferry_terminals|Ferry Terminals|transit|2
retail.convenience_stores|Convenience Stores|retail|2
retail.grocery|Grocery / Supermarket|retail|2
retail.shopping_malls|Shopping Malls|retail|2
retail.gas_stations|Gas Stations|retail|2
retail.electronics|Consumer Electronics|retail|2
retail.pharmacy|Pharmacy|retail|2
retail.apparel|Apparel|retail|2
retail.dealerships|Auto Dealerships|retail|2
retail.liquor_stores|Liquor Stores|retail|2
roadside.billboards|Billboards|roadside|2
roadside.bus_shelters|Bus Shelters|roadside|2
roadside.urban_panels|Urban Panels|roadside|2
outdoor.parks|Parks|outdoor|2
outdoor.beaches|Beaches|outdoor|2
outdoor.plazas|Plazas / Squares|outdoor|2
education.colleges_universities|Colleges & Universities|education|2
education.schools|Primary & Secondary Schools|education|2
education.early_learning|Early Learning|education|2
health_and_beauty.salons|Salons|health_and_beauty|2
health_and_beauty.spas|Spas|health_and_beauty|2
health_and_beauty.barbers|Barbers|health_and_beauty|2
point_of_care.hospitals|Hospitals|point_of_care|2
point_of_care.doctor_offices|Doctor Offices|point_of_care|2
point_of_care.dentist_offices|Dentist Offices|point_of_care|2
point_of_care.veterinary_offices|Veterinary Offices|point_of_care|2
entertainment.cinema|Cinemas|entertainment|2
entertainment.theaters|Theaters|entertainment|2
entertainment.casinos|Casinos|entertainment|2
entertainment.nightclubs|Nightclubs|entertainment|2
leisure.museums_galleries|Museums & Galleries|leisure|2
leisure.parks_attractions|Parks & Attractions|leisure|2
leisure.bowling_alleys|Bowling Alleys|leisure|2
government.municipal_buildings|Municipal Buildings|government|2
government.libraries|Libraries|government|2
office_buildings.office_towers|Office Towers|office_buildings|2
office_buildings.coworking|Coworking Spaces|office_buildings|2
residential.apartment_buildings|Apartment Buildings|residential|2
residential.condominiums|Condominiums|residential|2
financial.banks|Banks|financial|2
financial.atms|ATMs|financial|2
travel.hotels|Hotels|travel|2
travel.resorts|Resorts|travel|2
travel.hostels|Hostels|travel|2
sports_and_fitness.gyms|Gyms|sports_and_fitness|2
sports_and_fitness.stadiums|Stadiums & Arenas|sports_and_fitness|2
sports_and_fitness.golf_courses|Golf Courses|sports_and_fitness|2
hospitality.restaurants|Restaurants|hospitality|2
hospitality.fast_food|Fast Food|hospitality|2
hospitality.cafes|Cafés|hospitality|2
hospitality.bars|Bars|hospitality|2
industrial.factories|Factories|industrial|2
industrial.warehouses|Warehouses|industrial|2
farm.dairy_farms|Dairy Farms|farm|2
farm.livestock_farms|Livestock Farms|farm|2
"""

# Primary type | category | subcategory.
GOOGLE_TYPES = r"""
restaurant|hospitality|hospitality.restaurants
cafe|hospitality|hospitality.cafes
coffee_shop|hospitality|hospitality.cafes
bar|hospitality|hospitality.bars
pub|hospitality|hospitality.bars
fast_food_restaurant|hospitality|hospitality.fast_food
meal_takeaway|hospitality|hospitality.fast_food
bakery|hospitality|hospitality.cafes
food|hospitality|
convenience_store|retail|retail.convenience_stores
supermarket|retail|retail.grocery
grocery_store|retail|retail.grocery
shopping_mall|retail|retail.shopping_malls
department_store|retail|retail.shopping_malls
gas_station|retail|retail.gas_stations
electronics_store|retail|retail.electronics
clothing_store|retail|retail.apparel
car_dealer|retail|retail.dealerships
liquor_store|retail|retail.liquor_stores
pharmacy|retail|retail.pharmacy
drugstore|retail|retail.pharmacy
store|retail|
bank|financial|financial.banks
atm|financial|financial.atms
beauty_salon|health_and_beauty|health_and_beauty.salons
hair_salon|health_and_beauty|health_and_beauty.salons
spa|health_and_beauty|health_and_beauty.spas
hospital|point_of_care|point_of_care.hospitals
doctor|point_of_care|point_of_care.doctor_offices
dentist|point_of_care|point_of_care.dentist_offices
veterinary_care|point_of_care|point_of_care.veterinary_offices
movie_theater|entertainment|entertainment.cinema
night_club|entertainment|entertainment.nightclubs
casino|entertainment|entertainment.casinos
museum|leisure|leisure.museums_galleries
art_gallery|leisure|leisure.museums_galleries
tourist_attraction|leisure|leisure.parks_attractions
amusement_park|leisure|leisure.parks_attractions
lodging|travel|travel.hotels
hotel|travel|travel.hotels
resort_hotel|travel|travel.resorts
hostel|travel|travel.hostels
gym|sports_and_fitness|sports_and_fitness.gyms
stadium|sports_and_fitness|sports_and_fitness.stadiums
golf_course|sports_and_fitness|sports_and_fitness.golf_courses
school|education|education.schools
primary_school|education|education.schools
secondary_school|education|education.schools
university|education|education.colleges_universities
preschool|education|education.early_learning
city_hall|government|government.municipal_buildings
library|government|government.libraries
courthouse|government|government.municipal_buildings
police|government|government.municipal_buildings
airport|transit|transit.airports
bus_station|transit|transit.bus_stations
train_station|transit|transit.rail
subway_station|transit|transit.subway
taxi_stand|transit|transit.taxi_ride_share
ferry_terminal|transit|transit.ferry_terminals
"""

# Tag | category | subcategory; office=* stands for any other office.
OSM_TAGS = r"""
amenity=cafe|hospitality|hospitality.cafes
amenity=restaurant|hospitality|hospitality.restaurants
amenity=fast_food|hospitality|hospitality.fast_food
amenity=bar|hospitality|hospitality.bars
amenity=pub|hospitality|hospitality.bars
amenity=biergarten|hospitality|hospitality.bars
amenity=food_court|hospitality|hospitality.fast_food
amenity=ice_cream|hospitality|hospitality.cafes
amenity=bank|financial|financial.banks
amenity=atm|financial|financial.atms
amenity=hospital|point_of_care|point_of_care.hospitals
amenity=clinic|point_of_care|point_of_care.doctor_offices
amenity=doctors|point_of_care|point_of_care.doctor_offices
amenity=dentist|point_of_care|point_of_care.dentist_offices
amenity=veterinary|point_of_care|point_of_care.veterinary_offices
amenity=pharmacy|retail|retail.pharmacy
amenity=fuel|retail|retail.gas_stations
amenity=cinema|entertainment|entertainment.cinema
amenity=theatre|entertainment|entertainment.theaters
amenity=nightclub|entertainment|entertainment.nightclubs
amenity=casino|entertainment|entertainment.casinos
amenity=university|education|education.colleges_universities
amenity=college|education|education.colleges_universities
amenity=school|education|education.schools
amenity=kindergarten|education|education.early_learning
amenity=library|government|government.libraries
amenity=townhall|government|government.municipal_buildings
amenity=courthouse|government|government.municipal_buildings
amenity=police|government|government.municipal_buildings
amenity=post_office|retail|
amenity=bus_station|transit|transit.bus_stations
amenity=ferry_terminal|transit|transit.ferry_terminals
amenity=taxi|transit|transit.taxi_ride_share
shop=convenience|retail|retail.convenience_stores
shop=supermarket|retail|retail.grocery
shop=mall|retail|retail.shopping_malls
shop=department_store|retail|retail.shopping_malls
shop=electronics|retail|retail.electronics
shop=mobile_phone|retail|retail.electronics
shop=clothes|retail|retail.apparel
shop=car|retail|retail.dealerships
shop=alcohol|retail|retail.liquor_stores
shop=hairdresser|health_and_beauty|health_and_beauty.barbers
shop=beauty|health_and_beauty|health_and_beauty.salons
tourism=hotel|travel|travel.hotels
tourism=hostel|travel|travel.hostels
tourism=motel|travel|travel.hotels
tourism=guest_house|travel|travel.hotels
tourism=museum|leisure|leisure.museums_galleries
tourism=gallery|leisure|leisure.museums_galleries
tourism=attraction|leisure|leisure.parks_attractions
tourism=theme_park|leisure|leisure.parks_attractions
leisure=fitness_centre|sports_and_fitness|sports_and_fitness.gyms
leisure=sports_centre|sports_and_fitness|sports_and_fitness.gyms
leisure=stadium|sports_and_fitness|sports_and_fitness.stadiums
leisure=golf_course|sports_and_fitness|sports_and_fitness.golf_courses
leisure=park|outdoor|outdoor.parks
leisure=bowling_alley|leisure|leisure.bowling_alleys
office=*|office_buildings|office_buildings.office_towers
"""

# Folded part of a label | category | subcategory; the first that is contained wins.
SCRAPER_LABELS = r"""
trung tam thuong mai|retail|retail.shopping_malls
cua hang tien loi|retail|retail.convenience_stores
cua hang dien may|retail|retail.electronics
cua hang dien thoai|retail|retail.electronics
cua hang quan ao|retail|retail.apparel
nha thuoc|retail|retail.pharmacy
hieu thuoc|retail|retail.pharmacy
tram xang|retail|retail.gas_stations
sieu thi|retail|retail.grocery
cua hang|retail|
benh vien|point_of_care|point_of_care.hospitals
phong kham|point_of_care|point_of_care.doctor_offices
nha thuoc|retail|retail.pharmacy
nha hang|hospitality|hospitality.restaurants
quan an|hospitality|hospitality.restaurants
quan ca phe|hospitality|hospitality.cafes
ca phe|hospitality|hospitality.cafes
cafe|hospitality|hospitality.cafes
coffee|hospitality|hospitality.cafes
quan bar|hospitality|hospitality.bars
quan an nhanh|hospitality|hospitality.fast_food
thuc an nhanh|hospitality|hospitality.fast_food
ngan hang|financial|financial.banks
may rut tien|financial|financial.atms
atm|financial|financial.atms
khach san|travel|travel.hotels
nha nghi|travel|travel.hotels
hostel|travel|travel.hostels
rap chieu phim|entertainment|entertainment.cinema
phong gym|sports_and_fitness|sports_and_fitness.gyms
trung tam the duc|sports_and_fitness|sports_and_fitness.gyms
san van dong|sports_and_fitness|sports_and_fitness.stadiums
truong dai hoc|education|education.colleges_universities
dai hoc|education|education.colleges_universities
truong hoc|education|education.schools
mau giao|education|education.early_learning
bao tang|leisure|leisure.museums_galleries
phong tranh|leisure|leisure.museums_galleries
cong vien|outdoor|outdoor.parks
salon toc|health_and_beauty|health_and_beauty.salons
salon lam dep|health_and_beauty|health_and_beauty.salons
spa|health_and_beauty|health_and_beauty.spas
tho cat toc|health_and_beauty|health_and_beauty.barbers
san bay|transit|transit.airports
ben xe|transit|transit.bus_stations
ga tau|transit|transit.rail
restaurant|hospitality|hospitality.restaurants
convenience store|retail|retail.convenience_stores
supermarket|retail|retail.grocery
shopping mall|retail|retail.shopping_malls
pharmacy|retail|retail.pharmacy
bank|financial|financial.banks
hotel|travel|travel.hotels
cinema|entertainment|entertainment.cinema
hospital|point_of_care|point_of_care.hospitals
school|education|education.schools
"""

# Folded part of a name | category | subcategory; the first that is contained wins.
NAME_RULES = r"""
benh vien|point_of_care|point_of_care.hospitals
hospital|point_of_care|point_of_care.hospitals
phong kham|point_of_care|point_of_care.doctor_offices
clinic|point_of_care|point_of_care.doctor_offices
nha si|point_of_care|point_of_care.dentist_offices
nha thuoc|retail|retail.pharmacy
hieu thuoc|retail|retail.pharmacy
ngan hang|financial|financial.banks
khach san|travel|travel.hotels
hotel|travel|travel.hotels
nha hang|hospitality|hospitality.restaurants
quan an|hospitality|hospitality.restaurants
restaurant|hospitality|hospitality.restaurants
uy ban nhan dan|government|government.municipal_buildings
ubnd|government|government.municipal_buildings
cong an|government|government.municipal_buildings
thu vien|government|government.libraries
rap chieu phim|entertainment|entertainment.cinema
cgv|entertainment|entertainment.cinema
lotte cinema|entertainment|entertainment.cinema
san bay|transit|transit.airports
ben xe|transit|transit.bus_stations
ga tau|transit|transit.rail
circle k|retail|retail.convenience_stores
vinmart|retail|retail.convenience_stores
winmart|retail|retail.convenience_stores
co.opmart|retail|retail.grocery
highlands coffee|hospitality|hospitality.cafes
truong dai hoc|education|education.colleges_universities
hoc vien|education|education.colleges_universities
university|education|education.colleges_universities
college|education|education.colleges_universities
dai hoc|education|education.colleges_universities
truong mam non|education|education.early_learning
truong mn |education|education.early_learning
kindergarten|education|education.early_learning
preschool|education|education.early_learning
truong thpt|education|education.schools
truong thcs|education|education.schools
truong tieu hoc|education|education.schools
high school|education|education.schools
primary school|education|education.schools
truong|education|education.schools
school|education|education.schools
quan ca phe|hospitality|hospitality.cafes
ca phe|hospitality|hospitality.cafes
cafe|hospitality|hospitality.cafes
coffee|hospitality|hospitality.cafes
"""

# Category code | search words.
KEYWORDS = r"""
hospitality|restaurant;cafe;bar;nha hang;quan ca phe
hospitality.restaurants|restaurant;nha hang;quan an;Vietnamese restaurant
hospitality.cafes|cafe;coffee shop;quan ca phe;ca phe
hospitality.bars|bar;pub;quan bar;beer club
hospitality.fast_food|fast food;thuc an nhanh;kfc;lotteria;mcdonalds;burger king
retail|store;shop;cua hang;sieu thi
retail.convenience_stores|convenience store;cua hang tien loi;circle k;gs25;familymart;7-eleven;winmart+;ministop
retail.grocery|supermarket;sieu thi;co.opmart;winmart;lotte mart;big c;aeon
retail.shopping_malls|shopping mall;trung tam thuong mai;vincom;aeon mall;lotte mall
retail.gas_stations|gas station;tram xang;petrolimex;shell;caltex;pvoil
retail.electronics|electronics store;cua hang dien may;cua hang dien thoai;thegioididong;fpt shop;dien may xanh;nguyen kim
retail.pharmacy|pharmacy;nha thuoc;hieu thuoc;pharmacity;long chau;an khang
retail.apparel|clothing store;cua hang quan ao;fashion shop;thoi trang
retail.dealerships|car dealer;dai ly oto;showroom o to
retail.liquor_stores|liquor store;cua hang ruou;wine shop
financial|bank;atm;ngan hang
financial.banks|bank;ngan hang;vietcombank;vietinbank;bidv;agribank;techcombank;sacombank;acb;mb bank
financial.atms|atm;may rut tien
health_and_beauty|salon;spa;barber;salon toc;lam dep
health_and_beauty.salons|hair salon;beauty salon;salon toc;salon lam dep
health_and_beauty.spas|spa;massage;day spa
health_and_beauty.barbers|barber;tho cat toc;barber shop
point_of_care|hospital;clinic;benh vien;phong kham
point_of_care.hospitals|hospital;benh vien
point_of_care.doctor_offices|doctor;clinic;phong kham;phong mach
point_of_care.dentist_offices|dentist;nha si;phong kham nha khoa;dental clinic
point_of_care.veterinary_offices|veterinary;vet;phong kham thu y
entertainment|cinema;theater;rap chieu phim
entertainment.cinema|cinema;movie theater;rap chieu phim;cgv;lotte cinema;galaxy cinema
entertainment.theaters|theatre;nha hat;live theater
entertainment.casinos|casino;song bac
entertainment.nightclubs|nightclub;club;vu truong;ho dem
leisure|park;museum;attraction;cong vien;bao tang
leisure.museums_galleries|museum;art gallery;bao tang;phong tranh
leisure.parks_attractions|tourist attraction;amusement park;diem du lich;khu vui choi
leisure.bowling_alleys|bowling alley;san bowling
travel|hotel;khach san;nha nghi
travel.hotels|hotel;khach san
travel.resorts|resort;khu nghi duong
travel.hostels|hostel;nha nghi;homestay
sports_and_fitness|gym;sports center;phong gym;trung tam the duc
sports_and_fitness.gyms|gym;fitness center;phong gym;phong tap;california fitness
sports_and_fitness.stadiums|stadium;san van dong
sports_and_fitness.golf_courses|golf course;san golf
education|school;university;truong hoc;dai hoc
education.colleges_universities|university;college;truong dai hoc;hoc vien
education.schools|school;primary school;high school;truong tieu hoc;truong trung hoc
education.early_learning|preschool;kindergarten;mau giao;mam non
government|government office;library;uy ban;thu vien
government.municipal_buildings|city hall;uy ban nhan dan;courthouse;police station;cong an
government.libraries|library;thu vien
office_buildings|office building;toa nha van phong
office_buildings.office_towers|office tower;office building;toa nha van phong
office_buildings.coworking|coworking space;shared office;khong gian lam viec chung
residential|apartment;chung cu;can ho
residential.apartment_buildings|apartment building;chung cu;can ho
residential.condominiums|condominium;condo;can ho cao cap
transit|airport;bus station;san bay;ben xe
transit.airports|airport;san bay
transit.bus_stations|bus station;ben xe
transit.rail|train station;ga tau;ga xe lua
transit.subway|metro station;subway station;ga metro
transit.taxi_ride_share|taxi stand;diem don taxi
transit.ferry_terminals|ferry terminal;ben pha
outdoor|park;plaza;cong vien;quang truong
outdoor.parks|park;cong vien
outdoor.beaches|beach;bai bien
outdoor.plazas|plaza;square;quang truong
roadside|billboard;bus shelter;bien quang cao
roadside.billboards|billboard;bien quang cao
roadside.bus_shelters|bus stop;tram xe buyt
industrial.factories|factory;nha may
industrial.warehouses|warehouse;kho hang
farm.dairy_farms|dairy farm;trai bo sua
farm.livestock_farms|livestock farm;trang trai
"""

# Search words of unknown categories, and those of the scraper when no category is asked for.
DEFAULT_KEYWORDS = ('shop', 'restaurant')

# Code | name | short name | province codes.
REGIONS = r"""
R1|Trung du và miền núi phía Bắc|Northern midlands & mountains|02;04;06;08;10;11;12;14;15;17;19;20;24;25
R2|Đồng bằng sông Hồng|Red River Delta|01;22;26;27;30;31;33;34;35;36;37
R3|Bắc Trung Bộ và Duyên hải miền Trung|North Central & Central coast|38;40;42;44;45;46;48;49;51;52;54;56;58;60
R4|Tây Nguyên|Central Highlands|62;64;66;67;68
R5|Đông Nam Bộ|Southeast|70;72;74;75;77;79
R6|Đồng bằng sông Cửu Long|Mekong Delta|80;82;83;84;86;87;89;91;92;93;94;95;96
"""

# Category codes of a crawl tier, in order.
TIER_1 = r"""
retail.convenience_stores
retail.grocery
retail.shopping_malls
retail.cafes
retail.fashion
hospitality.casual_dining
hospitality.quick_service_restaurants
hospitality.coffee_shops
hospitality.bars
hospitality.hotels
point_of_care.hospitals
point_of_care.urgent_care_clinics
point_of_care.dentist_offices
health_and_beauty.pharmacies
financial.banks
financial.atms
"""

# Category codes of a crawl tier, in order.
TIER_2 = r"""
retail.gas_stations
retail.electronics
retail.home_improvement
retail.bookstores
retail.pet_stores
education.colleges_universities
education.schools
education.daycare
transit.airports
transit.gas_stations
transit.subway
transit.rail
transit.bus_stations
entertainment.cinemas
entertainment.casinos
leisure.parks
sports_and_fitness.gyms
sports_and_fitness.stadiums
government.post_offices
"""

# Category codes of a crawl tier, in order.
TIER_3 = r"""
travel.travel_agencies
office_buildings.office_buildings
residential.residential
outdoor.outdoor
roadside.roadside
industrial.industrial
farm.farm
"""

# Folded names that are provinces without a prefix.
PROVINCE_NAMES = r"""
an giang
ba ria vung tau
bac giang
bac lieu
bac ninh
ben tre
binh dinh
binh duong
binh phuoc
binh thuan
ca mau
can tho
cao bang
da nang
dak lak
dak nong
dien bien
dong nai
dong thap
gia lai
ha giang
ha nam
ha noi
ha tinh
hai duong
hai phong
hau giang
hcm
ho chi minh
hoa binh
hung yen
khanh hoa
kien giang
kon tum
lai chau
lam dong
lang son
lao cai
long an
nam dinh
nghe an
ninh binh
ninh thuan
phu tho
phu yen
quang binh
quang nam
quang ngai
quang ninh
quang tri
soc trang
son la
tay ninh
thai binh
thai nguyen
thanh hoa
thua thien hue
tien giang
tp hcm
tp ho chi minh
tphcm
tra vinh
tuyen quang
vinh long
vinh phuc
yen bai
"""

# Code | name | parent code | level | west | south | east | north.
ADMIN_UNITS = r"""
01|Hà Nội||1|105.3|20.55|106.05|21.4
02|Hà Giang||1|104.3|22.1|105.5|23.4
04|Cao Bằng||1|105.5|22.3|106.8|23.3
06|Bắc Kạn||1|105.4|21.85|106.3|22.8
08|Tuyên Quang||1|104.8|21.4|105.8|22.8
10|Lào Cai||1|103.55|21.85|104.7|22.85
11|Điện Biên||1|102.1|20.65|103.7|22.35
12|Lai Châu||1|102.8|21.4|104.0|22.8
14|Sơn La||1|103.1|20.6|105.3|22.1
15|Yên Bái||1|103.7|21.2|105.1|22.3
17|Hòa Bình||1|104.65|20.3|106.0|21.1
19|Thái Nguyên||1|105.5|21.3|106.3|22.05
20|Lạng Sơn||1|106.0|21.3|107.4|22.5
22|Quảng Ninh||1|106.5|20.7|108.1|21.7
24|Bắc Giang||1|105.85|21.15|107.1|21.8
25|Phú Thọ||1|104.8|20.8|105.65|21.85
26|Vĩnh Phúc||1|105.15|21.05|105.8|21.55
27|Bắc Ninh||1|105.85|20.95|106.3|21.3
30|Hải Dương||1|106.0|20.55|106.8|21.2
31|Hải Phòng||1|106.4|20.4|107.05|21.1
33|Hưng Yên||1|105.95|20.55|106.4|21.05
34|Thái Bình||1|106.05|20.2|106.85|20.8
35|Hà Nam||1|105.65|20.3|106.2|20.8
36|Nam Định||1|105.95|19.95|106.55|20.55
37|Ninh Bình||1|105.35|19.85|106.2|20.45
38|Thanh Hóa||1|104.3|19.2|106.1|20.65
40|Nghệ An||1|103.85|18.55|105.85|20.05
42|Hà Tĩnh||1|105.1|17.9|106.55|18.85
44|Quảng Bình||1|105.55|17.05|107.0|18.1
45|Quảng Trị||1|106.45|16.4|107.5|17.15
46|Thừa Thiên Huế||1|107.0|15.95|108.2|16.8
48|Đà Nẵng||1|107.95|15.95|108.4|16.3
49|Quảng Nam||1|107.2|14.95|108.8|16.2
51|Quảng Ngãi||1|108.1|14.3|109.2|15.4
52|Bình Định||1|108.35|13.55|109.4|14.75
54|Phú Yên||1|108.55|12.85|109.5|13.6
56|Khánh Hòa||1|108.55|11.8|109.7|12.95
58|Ninh Thuận||1|108.55|11.2|109.3|12.2
60|Bình Thuận||1|107.4|10.55|109.05|11.6
62|Kon Tum||1|107.2|13.85|108.7|15.3
64|Gia Lai||1|107.2|12.85|109.0|14.55
66|Đắk Lắk||1|107.5|12.1|109.0|13.3
67|Đắk Nông||1|107.1|11.65|108.2|12.85
68|Lâm Đồng||1|107.2|11.1|108.8|12.3
70|Bình Phước||1|106.2|11.2|107.45|12.3
72|Tây Ninh||1|105.85|10.85|106.8|11.85
74|Bình Dương||1|106.3|10.85|107.1|11.65
75|Đồng Nai||1|106.65|10.5|107.55|11.55
77|Bà Rịa - Vũng Tàu||1|107.0|10.2|107.8|10.85
79|Hồ Chí Minh||1|106.35|10.35|107.05|11.2
80|Long An||1|105.45|10.3|106.85|11.1
82|Tiền Giang||1|105.85|10.1|106.85|10.65
83|Bến Tre||1|105.95|9.75|106.75|10.4
84|Trà Vinh||1|105.95|9.45|106.7|10.05
86|Vĩnh Long||1|105.65|9.85|106.3|10.4
87|Đồng Tháp||1|105.1|10.0|106.05|10.95
89|An Giang||1|104.75|10.1|105.65|10.95
91|Kiên Giang||1|103.4|9.2|105.65|10.85
92|Cần Thơ||1|105.45|9.85|105.95|10.3
93|Hậu Giang||1|105.3|9.55|106.1|10.05
94|Sóc Trăng||1|105.4|9.1|106.4|9.95
95|Bạc Liêu||1|105.1|9.1|106.0|9.7
96|Cà Mau||1|104.55|8.45|105.55|9.55
01.001|Ba Đình|01|2|105.815|21.02|105.855|21.055
01.002|Hoàn Kiếm|01|2|105.84|21.015|105.87|21.045
01.003|Tây Hồ|01|2|105.795|21.04|105.865|21.11
01.004|Long Biên|01|2|105.87|20.985|105.985|21.09
01.005|Cầu Giấy|01|2|105.77|21.02|105.815|21.06
01.006|Đống Đa|01|2|105.81|21.0|105.855|21.03
01.007|Hai Bà Trưng|01|2|105.84|20.985|105.89|21.02
01.008|Hoàng Mai|01|2|105.825|20.945|105.91|21.0
01.009|Thanh Xuân|01|2|105.785|20.985|105.835|21.02
01.268|Hà Đông|01|2|105.715|20.94|105.815|21.005
01.269|Sơn Tây|01|2|105.43|21.06|105.555|21.18
01.018|Bắc Từ Liêm|01|2|105.715|21.045|105.8|21.11
01.019|Nam Từ Liêm|01|2|105.715|20.985|105.8|21.045
01.250|Sóc Sơn|01|2|105.7|21.14|105.965|21.35
01.271|Đông Anh|01|2|105.77|21.08|105.945|21.22
01.272|Gia Lâm|01|2|105.89|20.965|106.04|21.09
01.273|Mê Linh|01|2|105.62|21.14|105.825|21.29
01.274|Thanh Trì|01|2|105.81|20.87|105.965|20.965
01.275|Ba Vì|01|2|105.29|21.04|105.52|21.33
01.276|Phúc Thọ|01|2|105.475|21.02|105.62|21.18
01.277|Đan Phượng|01|2|105.605|21.04|105.73|21.165
01.278|Hoài Đức|01|2|105.65|20.965|105.755|21.08
01.279|Quốc Oai|01|2|105.5|20.91|105.715|21.08
01.280|Thạch Thất|01|2|105.42|20.945|105.64|21.13
01.281|Chương Mỹ|01|2|105.585|20.77|105.785|20.965
01.282|Thanh Oai|01|2|105.685|20.815|105.84|20.965
01.283|Thường Tín|01|2|105.815|20.755|105.965|20.89
01.284|Phú Xuyên|01|2|105.77|20.625|105.94|20.785
01.285|Ứng Hòa|01|2|105.62|20.62|105.815|20.815
01.286|Mỹ Đức|01|2|105.56|20.555|105.795|20.785
79.760|Quận 1|79|2|106.685|10.76|106.715|10.795
79.761|Quận 2|79|2|106.715|10.76|106.795|10.825
79.764|Quận 3|79|2|106.67|10.77|106.7|10.795
79.766|Quận 4|79|2|106.69|10.745|106.715|10.77
79.767|Quận 5|79|2|106.655|10.75|106.685|10.775
79.768|Quận 6|79|2|106.625|10.735|106.665|10.77
79.769|Quận 7|79|2|106.69|10.7|106.77|10.76
79.770|Quận 8|79|2|106.625|10.715|106.7|10.76
79.771|Quận 9|79|2|106.745|10.825|106.89|10.91
79.772|Quận 10|79|2|106.66|10.765|106.685|10.785
79.773|Quận 11|79|2|106.64|10.755|106.665|10.78
79.774|Quận 12|79|2|106.605|10.825|106.685|10.89
79.775|Bình Thạnh|79|2|106.685|10.785|106.73|10.825
79.776|Tân Bình|79|2|106.625|10.77|106.685|10.815
79.777|Tân Phú|79|2|106.61|10.76|106.66|10.81
79.778|Phú Nhuận|79|2|106.665|10.785|106.695|10.81
79.779|Thủ Đức|79|2|106.715|10.76|106.89|10.91
79.780|Gò Vấp|79|2|106.64|10.815|106.7|10.87
79.783|Bình Tân|79|2|106.58|10.715|106.64|10.795
79.784|Củ Chi|79|2|106.38|10.945|106.615|11.14
79.785|Hóc Môn|79|2|106.53|10.825|106.68|10.945
79.786|Bình Chánh|79|2|106.43|10.605|106.68|10.795
79.787|Nhà Bè|79|2|106.66|10.585|106.785|10.73
79.788|Cần Giờ|79|2|106.7|10.3|107.02|10.64
48.490|Hải Châu|48|2|108.19|16.04|108.245|16.085
48.491|Thanh Khê|48|2|108.17|16.04|108.21|16.08
48.492|Sơn Trà|48|2|108.22|16.06|108.33|16.155
48.493|Ngũ Hành Sơn|48|2|108.225|15.965|108.29|16.06
48.494|Liên Chiểu|48|2|108.09|16.04|108.18|16.155
48.495|Cẩm Lệ|48|2|108.155|15.995|108.23|16.045
48.497|Hòa Vang|48|2|107.985|15.945|108.19|16.18
48.498|Hoàng Sa|48|2|111.0|15.7|113.0|17.15
"""
