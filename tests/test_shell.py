"""The shell lexer and the checks of commands built on it."""

import pytest

from textloom.functions.shell import read_script
from textloom.operators.commands import option_runs, options_of, problems_of


def fence(*lines):
    return "```bash\n" + "\n".join(lines) + "\n```"


@pytest.mark.parametrize(
    ("script", "commands"),
    [
        ("a b; c && d | e & f", [["a", "b"], ["c"], ["d"], ["e"], ["f"]]),
        ('x=$(a "b c" `d e`) f', [["d", "e"], ["a", "b c", ""], ["x=", "f"]]),
        ('echo "in $(ls -l "$d") out" \'a;b\' \\; # c; d', [["ls", "-l", "$d"], ["echo", "in  out", "a;b", ";"]]),
        ("if a; then b; elif c; then d; else e; fi; f", [["a"], ["b"], ["c"], ["d"], ["e"], ["f"]]),
        ("for i in 1 2; do a $i; done > out 2>&1", [["for", "i", "in", "1", "2"], ["a", "$i"]]),
        ("cat <<E >f\na; b 'c\nE\nd", [["cat"], ["d"]]),
        ("a <<X <<Y\n1\nX\n2\nY\nb", [["a"], ["b"]]),
        ("case $x in a|b) c;; *) d;; esac; e", [["$x", "in", "a"], ["c"], ["d"], ["e"]]),
        ("y=$((1 << 2)); (( y > 3 )) && a ${b:-c d}", [["y=0"], ["a", "${b:-c d}"]]),
        ("(a; b) | { c; d; }", [["a"], ["b"], ["c"], ["d"]]),
        ("a \\\n  b", [["a", "b"]]),
        ("l=(a b c); d <(e f)", [["l="], ["e", "f"], ["d"]]),
    ],
)
def test_commands(script, commands):
    found = read_script(script)
    assert found.commands == commands and found.problem == ""


@pytest.mark.parametrize(
    ("script", "problem"),
    [
        ("", ""), ("echo \"it's\" 'a\"b' it\\'s", ""), ("echo 'open", "quote"), ('echo "open\nls', "quote"), ("a `b", "quote"), ("a $(b", "bracket"), ("(a; b", "bracket"), ("a)", "bracket"), ("a ${b", "bracket"),
        ("if a; then b", "block"), ("fi", "block"), ("for i in 1; do a; fi", "block"), ("while a; do b; done", ""), ("case a in b) c;; esac", ""), ("case a in b) c", "block"), ("{ a; }", ""), ("{ a", "block"),
        ("scontrol show job <jobid> --x <job_id>", ""), ("echo if then do", ""), ("echo $(if a; then b; fi)", ""), ("echo $(if a)", "block"), ("# it's open", ""), ("cat <<E\nit's\nE\n", ""), ("x=$((1+(2*3)))", ""),
        ("if [ -f x ]; then\n  echo hi\n", "block"),
    ],
)
def test_problems(script, problem):
    assert read_script(script).problem == problem


def test_options_of_scripts():
    text = "Try this:\n" + fence("#!/bin/bash", "#SBATCH --time=00:10:00", "#SBATCH --mem 4G", "srun --ntasks=2 python train.py --epochs 3", "jid=$(sbatch --parsable a.sh); sbatch --dependency=afterok:$jid b.sh")
    assert option_runs(text) == ["time", "mem", "ntasks", "parsable", "dependency"]
    assert option_runs(fence("salloc --nodes=1 --time=01:00:00 -- /bin/bash -c 'srun --ntasks=4 hostname'")) == ["nodes", "time"]
    assert options_of(fence("srun --contiguous --ntasks=4 ./a")) == ["contiguous", "ntasks"]
    assert options_of("```\ncd x; sbatch --nodes=2 j.sh\n```") == ["nodes"] and options_of("id=$(sbatch --parsable --mem=4G j.sh)") == ["mem", "parsable"]


SPEC = {
    "options": {
        "sbatch": ["time", "gres", "dependency", "parsable", "test-only", "tasks-per-node", "partition"], "srun": ["gpu-bind", "cpu-bind", "pty", "mpi", "interactive"], "salloc": ["time"], "sacct": ["format", "accounts", "starttime", "allusers"],
        "squeue": ["me", "format", "Format"], "scancel": ["me", "state"], "mpirun": ["np", "map-by", "bind-to"],
    },
    "job_commands": ["sbatch", "srun", "salloc"], "plugin_options": ["container-image", "ear", "ear-policy", "environment"], "one_dash": ["mpirun"], "subcommands": {"scontrol": ["show", "update", "requeue"]},
    "fields": {"sacct": [["--format", "-o"], ["JobID", "JobName", "State", "MaxRSS", "Elapsed", "ReqTRES", "NCPUS"]], "squeue": [["--Format", "-O"], ["JobID", "Partition", "State"]]}, "codes": {"squeue": [["--format", "-o"], "iPjTRbyQ"]},
}


@pytest.mark.parametrize(
    ("line", "problem"),
    [
        ("scontrol cancel 123", "scontrol: no command 'cancel'"), ("sacct --jobid 123", "sacct: no option --jobid"), ("sacct -j 123 --format=JobID,MaxGPU", "sacct: no format field 'MaxGPU'"), ("sacct -j 123 -o JobID,AllocTime", "sacct: no format field 'AllocTime'"),
        ("squeue -O JobID,GPUUtil", "squeue: no format field 'GPUUtil'"), ('squeue -o "%i %Q %s"', "squeue: no format code %s"), ("mpirun -np 8 --gpu-bind per-core ./app", "mpirun: no option --gpu-bind"), ("mpirun -np 8 -gpu-bind per-core ./app", "mpirun: no option --gpu-bind"),
        ("srun -n 8 mpirun -np 8 --gpu-bind per-core ./app", "mpirun: no option --gpu-bind"), ("srun --gpu-count=1 --pty bash", "srun: no option --gpu-count"), ("salloc -N 1 --pty bash", "salloc: no option --pty"), ("sbatch --mpi=pmix job.sh", "sbatch: no option --mpi"),
        ("#SBATCH --mount /a:/b", "sbatch: no option --mount"), ("#PBS -l nodes=2", "#PBS directive (not Slurm)"), ("#BSUB -n 4", "#BSUB directive (not Slurm)"),
    ],
)
def test_unknown_names_are_found(line, problem):
    assert problems_of(fence(line), SPEC) == [problem]


@pytest.mark.parametrize(
    "line",
    [
        "#SBATCH --gres=gpu:4", "srun --gpu-bind=closest --cpu-bind=cores ./app", "sacct -j 123 --format=JobID,State,MaxRSS%12,Elapsed,ReqTRES", "sacct -X --starttime=now-7days -o jobid,jobname,state", 'squeue --me -o "%.18i %.9P %j %T %R"', "squeue -O JobID:10,Partition,State",
        "sbatch --tasks-per-node=4 --part=boost_usr_prod job.sh", "sacct -X --account=myproj -o JobID,NCPU", "srun --container-image=nvcr.io#nvidia/pytorch:24.05-py3 python t.py", "#SBATCH --ear=on\n#SBATCH --ear-policy=monitoring", "scontrol update JobId=<jobid> TimeLimit=2:00:00",
        "mpirun -np 8 -x LD_LIBRARY_PATH --map-by ppr:4:node --bind-to core ./app --epochs 3", "mpirun -n 4 python train.py --lr 1", "watch -n 5 squeue --me", "jid=$(sbatch --parsable a.sh); sbatch --dependency=afterok:$jid b.sh", "# sacct --jobid in a comment is ignored",
    ],
)
def test_known_names_pass(line):
    assert problems_of(fence(line), SPEC) == []


def test_prose_is_no_code():
    assert problems_of("Note that `scontrol cancel` does not exist; use scancel.", SPEC) == [] and problems_of(None, SPEC) == []
