"""The taxonomy of place categories."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def load_taxonomy(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``position``, ``category`` and ``description`` of every known category.

    ``path`` is a JSON array of ``{category, description}``; without it the built-in
    list is used.
    """
    if path is None:
        lines = BUILT_IN.strip().splitlines()
        category, description = zip(*(line.split(": ", 1) for line in lines))
        # from Arrow it becomes a local relation, whose size the planner knows
        return spark.createDataFrame(
            pa.table(
                {
                    "position": pa.array(range(len(lines)), pa.int32()),
                    "category": list(category),
                    "description": list(description),
                }
            )
        )
    entry = "array<struct<category:string,description:string>>"
    whole = spark.read.text(path, wholetext=True)  # one small file, order matters
    return whole.select(
        F.posexplode(F.from_json("value", entry)).alias("position", "entry")
    ).select("position", "entry.category", "entry.description")


# The categories and their descriptions.
BUILT_IN = """
restaurant: A dining establishment serving meals
cafe: A casual dining establishment serving coffee, tea, and light meals
coffee_shop: A shop that primarily serves coffee
coffee_roaster: A business that roasts coffee beans
tea_house: A shop specializing in tea
bakery: A shop that bakes and sells bread and pastries
bar: An establishment serving alcoholic drinks
pub: A public house serving beer and food
fast_food: A quick-service restaurant
pizza: A restaurant specializing in pizza
sushi: A restaurant specializing in sushi
ice_cream: A shop selling ice cream
juice_bar: A shop selling fresh juices and smoothies
food_truck: A mobile food vendor
deli: A delicatessen selling prepared foods
butcher: A shop selling meat products
fish_market: A market selling fresh fish
wine_bar: An establishment specializing in wine
brewery: A business that brews beer
steakhouse: A restaurant specializing in steak
supermarket: A large store selling food and household items
convenience_store: A small store selling everyday items
bookstore: A store selling books
clothing_store: A store selling clothing
electronics_store: A store selling electronics
furniture_store: A store selling furniture
hardware_store: A store selling tools and hardware
pet_store: A store selling pet supplies
florist: A shop selling flowers and plants
gift_shop: A shop selling gifts and souvenirs
jewelry_store: A store selling jewelry
shoe_store: A store selling shoes
toy_store: A store selling toys
sports_store: A store selling sporting goods
department_store: A large store with multiple departments
shopping_mall: A large indoor shopping center
market: An open-air or indoor market
thrift_store: A store selling secondhand goods
antique_store: A store selling antiques
art_gallery: A gallery displaying and selling art
hospital: A medical facility for inpatient care
pharmacy: A store dispensing medications
dentist: A dental care provider
doctor: A general medical practitioner
optician: A provider of eyeglasses and eye exams
veterinarian: An animal medical care provider
clinic: A medical facility for outpatient care
physiotherapist: A physical therapy provider
psychologist: A mental health care provider
nursing_home: A residential care facility for elderly
bank: A financial institution offering banking services
atm: An automated teller machine
insurance: An insurance provider
accountant: An accounting and tax service
financial_advisor: A financial planning service
currency_exchange: A foreign currency exchange service
credit_union: A member-owned financial cooperative
school: An educational institution
university: A higher education institution
kindergarten: A preschool for young children
library: A public library
language_school: A school teaching languages
driving_school: A school teaching driving
music_school: A school teaching music
tutoring_center: A center providing tutoring services
college: A post-secondary educational institution
research_institute: A research and development institution
gas_station: A fuel station for vehicles
parking: A parking facility
bus_station: A bus terminal or station
train_station: A railway station
airport: An airport facility
car_rental: A car rental service
bicycle_rental: A bicycle rental service
taxi_stand: A designated taxi pickup point
car_wash: A vehicle washing facility
car_repair: An automotive repair shop
ev_charging: An electric vehicle charging station
ferry_terminal: A terminal for ferry services
hotel: A hotel providing accommodation
hostel: A budget accommodation
motel: A roadside hotel
bed_and_breakfast: A small lodging with breakfast
campground: A camping site
resort: A vacation resort
apartment_rental: A short-term apartment rental
cinema: A movie theater
theater: A performing arts theater
museum: A museum exhibiting collections
zoo: A zoological garden
aquarium: An aquatic animal exhibit
amusement_park: An amusement or theme park
nightclub: A nighttime entertainment venue
casino: A gambling establishment
bowling_alley: A bowling facility
escape_room: An escape room entertainment venue
concert_hall: A venue for concerts and performances
gym: A fitness center or gym
swimming_pool: A public swimming pool
tennis_court: A tennis facility
golf_course: A golf course
yoga_studio: A yoga and meditation studio
martial_arts: A martial arts training center
stadium: A sports stadium
sports_field: An outdoor sports field
climbing_gym: An indoor climbing facility
skating_rink: An ice or roller skating rink
post_office: A postal service office
courier: A courier and delivery service
laundry: A laundry or dry cleaning service
barber: A barbershop
hair_salon: A hair styling salon
beauty_salon: A beauty and cosmetics salon
spa: A spa and wellness center
tailor: A clothing alteration and tailoring service
locksmith: A lock and key service
plumber: A plumbing service
electrician: An electrical service
moving_company: A moving and relocation service
real_estate: A real estate agency
lawyer: A legal services firm
notary: A notary public
translator: A translation service
print_shop: A printing service
photographer: A photography service
funeral_home: A funeral and mortuary service
travel_agency: A travel booking agency
police_station: A police station
fire_station: A fire station
city_hall: A municipal government building
embassy: A foreign embassy or consulate
courthouse: A court of law
community_center: A community gathering place
recycling_center: A waste recycling facility
church: A Christian church
mosque: An Islamic mosque
synagogue: A Jewish synagogue
temple: A religious temple
park: A public park
garden: A public or botanical garden
nature_reserve: A protected natural area
beach: A beach or waterfront area
playground: A children's playground
coworking_space: A shared workspace for professionals
data_center: A data storage and processing facility
tech_startup: A technology startup company
computer_repair: A computer repair service
internet_cafe: A cafe with internet access
warehouse: A storage warehouse
factory: A manufacturing facility
construction_site: An active construction site
power_plant: An electrical power generation facility
water_treatment: A water treatment facility
dog_park: A park designated for dogs
car_dealership: An automobile dealership
bike_shop: A bicycle sales and repair shop
pawn_shop: A pawn and loan shop
vape_shop: A vaporizer and e-cigarette shop
tattoo_parlor: A tattoo and body art studio
event_venue: A venue for events and conferences
wedding_venue: A venue for wedding ceremonies
storage_facility: A self-storage facility
cemetery: A burial ground
"""
