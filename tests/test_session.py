from pathlib import Path

from brinewell.session import cut_lineage, drop_cut_tables, shared_dir, ship


def test_cut_tables_are_in_the_shared_folder_and_can_be_dropped(spark):
    drop_cut_tables(spark)
    df = cut_lineage(spark.range(5))
    assert df.count() == 5 and all(shared_dir(spark).removeprefix("file:") in f.removeprefix("file:").replace("//", "/") for f in df.inputFiles())
    folder = Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert folder.exists() and drop_cut_tables(spark) == 1 and not folder.exists()


def test_code_is_shipped_once(spark):
    ship(spark)
    ship(spark)
    assert spark.sparkContext._brinewell_shipped
